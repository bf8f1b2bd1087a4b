"""Column functions: names, times, texts, numbers, sets and intervals. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: classes of messages, the first with a keyword wins; keywords that are counted; what templates replace, in order
SEMANTIC_RULES = (
    ("flap", ("flap", "flapping")),
    ("unavailable", ("unavailable", "no route", "unreachable")),
    ("timeout", ("timeout", "timed out")),
    ("refused", ("refused",)),
    ("down", ("down", "went down", "shutdown")),
    ("up", ("up", "established", "comes up")),
    ("change", ("change", "changed", "update", "added", "removed", "withdraw")),
    ("error", ("error", "err", "could not", "failed", "failure")),
    ("warning", ("warn",)),
)
KEYWORDS = tuple("bgp ospf route link interface acl deny drop cpu memory disk dns web auth timeout error fail down flap blackhole port rule default_route".split())
TEMPLATE = (
    (r'"[^"]*"', "<str>"),
    (r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b", "<ip>"),
    (r"\b(?:[0-9a-fA-F]{0,4}:){2,}[0-9a-fA-F]{0,4}\b", "<ipv6>"),
    (r"\b[0-9a-fA-F]{6,}\b", "<hex>"),
    (r"\b[0-9]+\b", "<n>"),
    (r"\s+", " "),
)
# fixed values: regions by the name of their place, and the elements of a region
REGION_NAMES = (("北大", "beida"), ("成都", "chengdu"), ("广州", "guangzhou"), ("南京", "nanjing"), ("上海", "shanghai"), ("武汉", "wuhan"), ("西安", "xian"))
ELEMENTS = ("br-1", "br-2", "cr-1", "cr-2", "fw", "traffic-vm", "service-vm-1", "service-vm-2", "service-vm-3", "monitor-vm")
ROLE = r"(service-vm-[0-9]+|traffic-vm|monitor-vm|br-[0-9]+|cr-[0-9]+|fw)"
ROLE_FAMILY = r"^(service-vm|traffic-vm|monitor-vm|br|cr|fw)"
SATURATION = 197362.0


def snake(c: Column) -> Column:
    """Lower case, runs of other characters one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def alias_key(c: Column) -> Column:
    """Letters and digits only, in lower case: names that differ in separators fall together."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def canonical_node(c: Column) -> Column:
    """role-number for names like br2, BR-2 or x-br02-y; firewalls under any alias are fw; else the trimmed lower-case name."""
    low = F.lower(F.trim(c))
    role = F.regexp_extract(low, r"(cr|br|er|sw)[-_]?0*([0-9]+)", 1)
    number = F.regexp_extract(low, r"(cr|br|er|sw)[-_]?0*([0-9]+)", 2)
    return F.when(low.rlike(r"(^|[^a-z])(fw|firewall)([^a-z]|$)"), "fw").when(role != "", F.concat_ws("-", role, number)).otherwise(low)


def element_id(region: Column, node: Column) -> Column:
    return F.when(node.startswith(F.concat(region, F.lit("-"))), node).otherwise(F.concat_ws("-", region, node))


def repaired_element_id(c: Column, region: Column) -> Column:
    """Repeated region prefixes become one; a missing one is added."""
    bare = F.regexp_replace(c, F.concat(F.lit("^("), region, F.lit("-)+")), F.lit(""))
    return F.concat_ws("-", region, bare)


def host_of(c: Column) -> Column:
    """The host of host:port and [v6]:port; a bare IPv6 address stays whole."""
    return F.when(c.startswith("["), F.regexp_extract(c, r"^\[([^\]]*)\]", 1)).when(F.length(c) - F.length(F.replace(c, F.lit(":"), F.lit(""))) >= 2, c).otherwise(F.regexp_extract(c, "^([^:]*)", 1))


def region_of(c: Column) -> Column:
    return F.regexp_extract(c, "^([a-z]+)[-_]", 1)


def region_code(name: Column) -> Column:
    """The region of a dataset's name: its leading letters before a separator, else a place that it names, else the name in snake case."""
    lead = F.lower(F.regexp_extract(name, "^([a-zA-Z]+)[_-]", 1))
    out = F.when(lead != "", lead)
    for place, code in REGION_NAMES:
        out = out.when(name.contains(place), code)
    slug = F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
    return out.otherwise(F.when(slug == "", "unknownregion").otherwise(F.lower(slug)))


def role_key(element: Column) -> Column:
    """The role at the end of an element's id, which regions share; the trimmed id if it has none."""
    own = F.regexp_extract(F.trim(element), ROLE + "$", 1)
    return F.when(own != "", own).otherwise(F.trim(element))


def role_of(element: Column, unknown: str = "?") -> Column:
    """The first role that an element's id names."""
    own = F.regexp_extract(element, ROLE, 1)
    return F.when(own != "", own).otherwise(unknown)


def role_family(element: Column, unknown: str = "?") -> Column:
    """The role without its number."""
    own = F.regexp_extract(role_of(element, unknown), ROLE_FAMILY, 1)
    return F.when(own != "", own).otherwise(unknown)


def repaired_id(element: Column, region: Column, regions: tuple[str, ...], elements: tuple[str, ...] = ELEMENTS) -> Column:
    """(id, action): ok as it is; stripped of repeated region prefixes; added one where there was none; else unparsable, and unchanged."""
    either = "|".join(regions)
    bare = F.regexp_replace(element, f"^(?:(?:{either})-)+", "")
    once = F.regexp_replace(element, f"^(?:{either})-", "")
    legal = lambda c: c.isin(*elements)
    action = (
        F.when(element.isNull() | (element == ""), "unparsable")
        .when((once != element) & legal(once), "ok")
        .when(legal(bare) & region.isNull(), "unparsable")
        .when((bare != element) & legal(bare), "stripped")
        .when(legal(element), "added")
        .otherwise("unparsable")
    )
    return F.struct(F.when(action.isin("stripped", "added"), F.concat_ws("-", region, bare)).otherwise(element).alias("id"), action.alias("action"))


def point_id(dataset: Column, element: Column, ts: Column) -> Column:
    """dataset:element:time, the time to the second in UTC."""
    return F.concat_ws(":", dataset, element, F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def bin_of(ts: Column, minutes: int) -> Column:
    """The start of the bin; null times stay null."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts.cast("timestamp")) / (minutes * 60)) * (minutes * 60))


def cyclic(ts: Column) -> list[Column]:
    """Sine and cosine of the hour and of the day of the week (Monday 0)."""
    hour, day = 2 * F.pi() * F.hour(ts) / 24, 2 * F.pi() * F.weekday(ts) / 7
    return [F.sin(hour).alias("hour_sin"), F.cos(hour).alias("hour_cos"), F.sin(day).alias("dow_sin"), F.cos(day).alias("dow_cos")]


def template(c: Column) -> Column:
    """A message without its variable parts."""
    for pattern, to in TEMPLATE:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def semantic_class(message: Column, severity: Column | None = None) -> Column:
    low, out = F.lower(message), None
    for name, words in SEMANTIC_RULES:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    if severity is not None:
        out = out.when(severity.try_cast("double") <= 3, "error")
    return out.otherwise("info")


def keyword_flags(message: Column, keywords: tuple[str, ...] = KEYWORDS) -> list[Column]:
    return [F.lower(message).contains(k).cast("double").alias(f"kw_{k}") for k in keywords]


def label_map(labels: Column) -> Column:
    """k="v",... as a map; the order of labels does not matter."""
    names = F.regexp_extract_all(labels, F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="([^"]*)"'), F.lit(1))
    return F.map_from_arrays(names, F.regexp_extract_all(labels, F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="([^"]*)"'), F.lit(2)))


def label_key(labels: Column) -> Column:
    """Labels in order, as text: equal for equal sets of labels."""
    return F.array_join(F.array_sort(F.filter(F.transform(F.split(labels, ","), F.trim), lambda x: x != "")), ",")


def clamped(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Between the bounds; null and NaN become the lower one."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.nanvl(c, F.lit(low)), F.lit(low))))


def log_saturation(c: Column, full: float = SATURATION) -> Column:
    """0 up to 1 on a logarithmic scale that is full at ``full``; nothing positive gives 0."""
    return F.when(c > 0, F.least(F.lit(1.0), F.log1p(c) / F.log1p(F.lit(full)))).otherwise(0.0)


def level(c: Column, edges: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0), names: tuple[str, ...] = ("none", "low", "mid", "high", "extreme")) -> Column:
    """The name of the first edge that a value is below; nulls have the first name."""
    out = F.when(c.isNull(), names[0])
    for edge, name in zip(edges, names):
        out = out.when(c < edge, name)
    return out.otherwise(names[len(edges)])


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """How much [a, b] and [c, d] have in common; never negative."""
    return F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))


def dice(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Twice the common length over the sum of lengths; 0 if both are empty."""
    total = (b - a) + (d - c)
    return F.when(total > 0, F.lit(2.0) * overlap(a, b, c, d) / total).otherwise(0.0)


def overlap_ratio(a: Column, b: Column, c: Column, d: Column, least: float = 60.0) -> Column:
    """The common length over the longer one, which counts as ``least`` at least."""
    return overlap(a, b, c, d) / F.greatest(b - a, d - c, F.lit(least))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
