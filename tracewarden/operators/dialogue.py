"""Conversations with a language model about one incident: tool calls, answers, and what is done with them. Driver-side; one incident at a time."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.operators.decisions import Backend, _balanced
from tracewarden.operators.toolbox import Toolbox

ASK_AGAIN = "The answer held no JSON object. Reply with the JSON object only."
#: Rows of a tool's result that a message shows.
SHOWN_ROWS = 50


class Chat:
    """A model that continues a list of messages (role, content, ...) with one message."""

    def reply(self, messages: list[dict], tools: tuple[str, ...]) -> dict:
        raise NotImplementedError


class HttpChat(Chat, Backend):
    """A service with the common chat-completions interface; tried again with growing waits."""

    def __init__(self, url: str, model: str, key: str = "", timeout: int = 120, most_tokens: int = 1024, tries: int = 3, wait: float = 1.0) -> None:
        self.url, self.model, self._key, self.timeout, self.most_tokens, self.tries, self.wait = url.rstrip("/"), model, key, timeout, most_tokens, tries, wait

    def reply(self, messages: list[dict], tools: tuple[str, ...] = ()) -> dict:
        body = {"model": self.model, "messages": messages, "max_tokens": self.most_tokens, "temperature": 0}
        if tools:
            body["tools"] = [{"type": "function", "function": {"name": t, "parameters": {"type": "object"}}} for t in tools]
        request = urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", **({"Authorization": f"Bearer {self._key}"} if self._key else {})})
        for n in range(self.tries):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)["choices"][0]["message"]
            except (OSError, KeyError, ValueError):
                if n + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**n)
        raise RuntimeError("not reached")

    def answer(self, prompts: list[str]) -> list[str]:
        return [self.reply([{"role": "user", "content": p}]).get("content") or "" for p in prompts]


def tool_calls(message: dict) -> list[dict]:
    """id, name and arguments of each call in a message; arguments may be an object or text of one, and what is no object counts as none."""
    out = []
    for call in message.get("tool_calls") or ():
        function = call.get("function") if isinstance(call, dict) else None
        if not isinstance(function, dict) or not function.get("name"):
            continue
        arguments = function.get("arguments")
        if isinstance(arguments, str):
            try:
                arguments = json.loads(arguments)
            except ValueError:
                arguments = None
        out.append({"id": call.get("id") or f"call_{len(out) + 1}", "name": function["name"], "arguments": arguments if isinstance(arguments, dict) else {}})
    return out


def json_object(text: str | None) -> dict | None:
    """The last object in free text."""
    found = _balanced(text or "")
    try:
        return json.loads(found) if found else None
    except ValueError:
        return None


def converse(chat: Chat, toolbox: Toolbox, messages: list[dict], rounds: int = 8) -> tuple[dict | None, list[dict]]:
    """(the final object or None, all messages): tools are called as asked, answers without an object are asked for again, for so many rounds."""
    messages = list(messages)
    for _ in range(rounds):
        message = {"role": "assistant", **chat.reply(messages, toolbox.TOOLS)}
        messages.append(message)
        calls = tool_calls(message)
        for call in calls:
            try:
                result = [r.asDict(True) for r in toolbox.call_tool(call["name"], call["arguments"]).limit(SHOWN_ROWS).collect()]
            except Exception as gone:  # the model is told, and may ask otherwise
                result = {"error": str(gone).split("\n")[0], "tool": call["name"]}
            messages.append({"role": "tool", "tool_call_id": call["id"], "name": call["name"], "content": json.dumps(result, default=str)})
        if calls:
            continue
        if (answer := json_object(message.get("content"))) is not None:
            return answer, messages
        messages.append({"role": "user", "content": ASK_AGAIN})
    return None, messages


def allowed(ids: Iterable[str], official: Iterable[str]) -> list[str]:
    """The official ones among the ids, each once, in order."""
    legal = set(official)
    return list(dict.fromkeys(x for x in ids if x in legal))


def reranked(answer: dict | None, candidates: list[str], k: int = 5) -> tuple[list[str], int]:
    """(order, hallucinated): the answer's elements that are candidates, then the candidates it leaves out; how many named elements are none."""
    named = [str(x.get("network_element_id", x)) if isinstance(x, dict) else str(x) for x in (answer or {}).get("root_cause_top5", ()) or ()]
    kept = allowed(named, candidates)
    return [*kept, *(c for c in candidates if c not in set(kept))][:k], sum(n not in set(candidates) for n in named)


def dependency_text(incidents: DataFrame, edges: DataFrame) -> DataFrame:
    """(incident, text): a line for each element of an incident with what is up- and downstream of it. ``incidents``: incident, nodes; ``edges``: src, dst, kind."""
    nodes = incidents.select("incident", F.posexplode("nodes").alias("place", "node"))
    name = lambda other: F.format_string("%s(%s)", other, "kind")
    up = edges.groupBy(F.col("dst").alias("node")).agg(F.concat_ws(", ", F.array_sort(F.collect_set(name("src")))).alias("up"))
    down = edges.groupBy(F.col("src").alias("node")).agg(F.concat_ws(", ", F.array_sort(F.collect_set(name("dst")))).alias("down"))
    line = F.format_string("- %s: upstream=[%s], downstream=[%s]", "node", F.coalesce("up", F.lit("none")), F.coalesce("down", F.lit("none")))
    told = nodes.join(up, "node", "left").join(down, "node", "left").withColumn("line", line)
    return told.groupBy("incident").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("text"))


def pair_prompts(pairs: DataFrame, one: Callable[[Column], Column], most: int = 50) -> DataFrame:
    """Questions whether two incidents are one, for the ``most`` pairs (x, y, affinity) that are least clear: nearest to one half."""
    near = pairs.orderBy(F.abs(F.col("affinity") - 0.5), "x", "y").limit(most)
    return near.withColumn("prompt", F.concat_ws("\n", F.lit("Are these two incidents one? Answer {\"same\": true|false}."), one(F.col("x")), one(F.col("y"))))
