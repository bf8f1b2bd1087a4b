"""Licence scans: canonical digests of entire texts, hash-joined to the digests of known licences.

A text is brought to a canonical form: lower case, lines that only state a copyright gone,
punctuation and white space one space each, equivalent spellings made one. The form that is looked
up also lacks titles and 'all rights reserved', and keeps sentences that wrap to a line which starts
with 'copyright'; ``digest`` stays that of the plain form. The SHA-256 is joined to those of the
known texts, whose number is fixed by the table below, so the known side may be broadcast. Single lines are looked up too, since notices of one line stand in longer texts; only
lines that match are grouped by document. Everything is DataFrame functions.

Null texts count as empty and match nothing. Rows are joined by a hash of id and text, so rows
that share an id keep their own results; repeated rows are treated alike. Texts and lines of any
length are looked up whole. Empty tables give empty results; other columns are ignored, whatever
their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.shared import NO_ID

# fixed values: lines that state a copyright, what counts as a space, and spellings made equal
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*(?:copyright|\(c\)|©)[^\n]*$"
COPYRIGHT_HINT = r"copyright|\(c\)|©"
# fixed values of the form that is looked up: a line states a holder or year, reserves all rights, or is the title of a text that is known without it
HOLDER_LINE = r"(?m)^[ \t#*/;-]*(?:copyright[ \t:]*(?:\(c\)|©|[\[<{(]?[ \t]*(?:\d{4}|yyyy|year))|\(c\)[ \t]*(?:copyright[ \t]*)?[\[<{(]?(?:\d{4}|yyyy|year)|©)[^\n]*$"
RIGHTS_LINE = r"(?m)^[ \t#*/;-]*all rights reserved\.?[ \t*/\r]*$"
TITLE_LINE = r"""(?m)^[ \t#*/;=(-]*(?:the )?(?:mit licen[cs]e(?: \(mit\))?|(?:expat|mit/expat) licen[cs]e|isc licen[cs]e(?: \(iscl?\))?|(?:bsd )?zero[- ]clause bsd licen[cs]e(?: \(0bsd\))?|bsd zero[- ]clause licen[cs]e(?: \(0bsd\))?|0bsd licen[cs]e|(?:(?:new|modified|revised|simplified|original) )?(?:bsd )?(?:[23]|two|three)[- ]clause (?:bsd )?(?:"?(?:new|revised|simplified)"?(?: or "?(?:new|revised|simplified|freebsd)"?)? )?licen[cs]e|(?:new |modified |revised |simplified )?bsd licen[cs]e)[.:)]*[ \t*/=\r]*$"""
FORM_HINT = r"copyright|\(c\)|©|all rights reserved|licen[cs]e"
LINE_HINT = "licen|spdx|copyright|permission"
NO_SPACE = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("per cent", "percent"),
    ("https", "http"),
    ("ver", "version"),
    ("v2 0", "version 2 0"),
    ("v3", "version 3"),
)
# fixed values: known licences and notices
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
)


#: Whole texts by the SHA-256 of the form that is looked up; with variants in which they are in use (numbered or not, with or without the appendix).
DIGESTS = (
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Apache-2.0", "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff"),
    ("Apache-2.0", "6fb8411669deea22294b6190fad00b8e39899d0b7b6c5cf97a3b15b47e129c38"),
    ("Artistic-1.0-Perl", "64e91f5cc481723b420f8e1ecf131ec7eba02da96cf0a78bb4b764fb30984f7a"),
    ("BSD-2-Clause", "925e3306eb4a5616de812ebe7636c82195825e66ae2e33f8b7f4a9697c78b03b"),
    ("BSD-2-Clause", "8027774096368556510a578ff4d19ab28b8072aa988cce24dfe85b7afbee8999"),
    ("BSD-2-Clause", "e835d4cab37d82b2782bf5a09cc12632e08714f367ecb670b91be8249b235ba6"),
    ("BSD-2-Clause", "6091119410d6d441128c7514a97969723030816ec99a6b3939b6c4dfbe349d7e"),
    ("BSD-3-Clause", "ab899150d08a3ccf837f742a20fbd8dd108031100312f3224aa5e2d14e0d60f1"),
    ("BSD-3-Clause", "80e928d346053a16374bd8965df8b724bde7813286c7acf4e9c041e405fcddc8"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC-BY-SA-4.0", "03d8a3b9c6db6790c3520a25812373d89c7f2a005ef01b18a0abcd015657a456"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd"),
    ("GFDL-1.3", "7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-2.0", "0c64ee746791150d3c6210d29a2984d92afca30fa433f834ca884a3002b96384"),
    ("GPL-3.0", "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("NCSA", "2ad8f6130122c81134816d3c2382f6acbf3405b4a64d5dc8ae203a77c5f31585"),
    ("OFL-1.1", "869f1a9ecdc619b007404d7468c79975517aca73c87fcba1826bb207db26a2e1"),
    ("Unicode-3.0", "6206dc9e424a934a8cdee8c2af92797731ea0c3df2cf20b96f29960cb75e4d42"),
    ("Unlicense", "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd"),
)


def _words(plain: Column) -> Column:
    """Words with one space between them, spellings made equal; spaces are doubled meanwhile, so that every word has its own on either side."""
    spaced = F.concat(F.lit(" "), F.replace(F.trim(F.regexp_replace(plain, NO_SPACE, " ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    for other, one in SPELLINGS:
        spaced = F.replace(spaced, F.lit(f" {other} ".replace(" ", "  ")[1:-1]), F.lit(f" {one} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.replace(spaced, F.lit("  "), F.lit(" ")))


def canonical(text: Column) -> Column:
    """The canonical form: words of ASCII letters and digits or of other characters, one space between them."""
    low = F.lower(text)
    return _words(F.when(low.rlike(COPYRIGHT_HINT), F.regexp_replace(low, COPYRIGHT_LINE, "")).otherwise(low))


def looked_up(text: Column) -> Column:
    """The form that known texts are found by: as ``canonical``, but sentences that wrap to 'copyright' stay, and titles go."""
    low = F.lower(text)
    plain = low
    for line in (HOLDER_LINE, RIGHTS_LINE, TITLE_LINE):
        plain = F.regexp_replace(plain, line, "")
    return _words(F.when(low.rlike(FORM_HINT), plain).otherwise(low))


def known(spark) -> DataFrame:
    """known (a digest), license: of fixed size."""
    table = spark.createDataFrame(list(KNOWN), "license string, text string")
    return table.select(F.sha2(looked_up(F.col("text")), 256).alias("known"), "license").unionAll(spark.createDataFrame(list(DIGESTS), "license string, known string").select("known", "license")).groupBy("known").agg(F.min("license").alias("license"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the whole canonical text, license (of the whole text, or null), n_license_lines and line_licenses (sorted, comma-joined)."""
    spark = docs.sparkSession
    table = F.broadcast(known(spark))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("k1"), F.xxhash64("text").alias("k2"))
    # both forms of a text without any of the hints are the same, so most texts are brought to one form only
    plain = keyed.select("doc_id", "k1", "k2", "text", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    known_form = F.when(F.lower("text").rlike(FORM_HINT), F.sha2(looked_up(F.col("text")), 256)).otherwise(F.col("digest"))
    whole = plain.select("doc_id", "k1", "k2", "digest", known_form.alias("known")).join(table, "known", "left")
    lines = keyed.select("k1", "k2", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(LINE_HINT))).alias("line", "body"))
    found = lines.select("k1", "k2", "line", F.sha2(looked_up(F.col("body")), 256).alias("known")).join(table, "known")
    by_text = found.groupBy("k1", "k2").agg(F.countDistinct("line").alias("n_license_lines"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"))
    return whole.join(by_text, ["k1", "k2"], "left").select("doc_id", "digest", "license", F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"), F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))


def oracle_sql() -> str:
    """The same as DuckDB SQL; spellings are changed word by word in a list first, then those of two words."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    single = " ".join(f"WHEN {quote(other)} THEN {quote(one)}" for other, one in SPELLINGS if " " not in other)
    double = [(other, one) for other, one in SPELLINGS if " " in other]

    def digest(text: str, *gone: str) -> str:
        out = f"lower({text})"
        for line in gone:
            out = f"regexp_replace({out}, {quote(line)}, '', 'g')"
        words = f"list_filter(string_split(regexp_replace({out}, {quote(NO_SPACE)}, ' ', 'g'), ' '), lambda w: w <> '')"
        out = f"'/' || list_aggregate(list_transform({words}, lambda w: CASE w {single} ELSE w END), 'string_agg', '//') || '/'"
        for other, one in double:
            out = f"replace({out}, {quote('/' + other.replace(' ', '//') + '/')}, {quote('/' + one.replace(' ', '//') + '/')})"
        return f"sha256(replace(trim(coalesce({out}, ''), '/'), '//', ' '))"

    form = lambda text: digest(text, HOLDER_LINE, RIGHTS_LINE, TITLE_LINE)
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    digests = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in DIGESTS)
    return f"""
    WITH known AS (SELECT known, min(license) AS license FROM (SELECT l AS license, {form('t')} AS known FROM (VALUES {values}) AS v(l, t) UNION ALL FROM (VALUES {digests}) AS w(license, known)) GROUP BY 1),
    docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    whole AS (SELECT doc_id, {digest('text', COPYRIGHT_LINE)} AS digest, {form('text')} AS known FROM docs),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
    found AS (
      SELECT doc_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(license))), ',') AS names
      FROM (SELECT doc_id, {form('line')} AS known FROM lines WHERE regexp_matches(lower(line), {quote(LINE_HINT)})) JOIN known USING (known) GROUP BY doc_id)
    SELECT w.doc_id, w.digest, k.license, coalesce(f.n, 0)::BIGINT AS n_license_lines, coalesce(f.names, '') AS line_licenses
    FROM whole w LEFT JOIN known k USING (known) LEFT JOIN found f ON f.doc_id = w.doc_id"""
