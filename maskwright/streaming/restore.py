"""Answers that arrive in pieces: tokens back to names without ever taking back what was shown."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.fold import deconfuse_ascii
from ..plans.requests import LOCAL_TOOLS, Restores, back, holdback
from ..functions.jsontext import replaced


class TextRestorer:
    """One block of text: `feed` gives what is safe to show, `finish` the rest.

    Safe is the longest beginning whose end can be no part of a token of the mapping, of a name that
    holds one, or of an open code span that does.
    """

    def __init__(self, mapping: dict[str, str], table: dict[str, str] | None = None, text: str = "", shown: int = 0):
        self.mapping, self.table, self.text, self.shown = mapping, table or {}, text, shown
        self.beginnings = {t.casefold()[:i] for t in mapping for i in range(1, len(t) + 1)}
        self.longest = max(map(len, mapping), default=0)

    def _held(self) -> int:
        hold = holdback(self.text, self.table)
        for n in range(min(len(self.text), self.longest), 0, -1):
            if deconfuse_ascii(self.text[-n:]).casefold() in self.beginnings:
                return max(n, hold)
        return hold

    def feed(self, delta: str, final: bool = False) -> str:
        self.text += delta
        end = len(self.text) if final else len(self.text) - self._held()
        full = back(self.text[:end], self.mapping, self.table, prose=True)
        out, self.shown = full[self.shown :], max(self.shown, len(full))
        return out

    def finish(self) -> str:
        return self.feed("", final=True)


class EventRestorer:
    """A stream of (name, data) events of either form of answer, event by event, with inserted events numbered in."""

    def __init__(self, mapping: dict[str, str], restores: Restores | None = None, table: dict[str, str] | None = None, local: frozenset[str] = LOCAL_TOOLS):
        self.mapping, self.restores, self.table, self.local = mapping, restores or Restores(), table or {}, local
        self.texts: dict = {}
        self.tools: dict = {}
        self.usage: dict = {}
        self.number: int | None = None

    def event(self, name: str, data: dict) -> list[tuple[str, dict]]:
        self._count(data)
        return self._numbered(self._messages(name, data) if "sequence_number" not in data else self._responses(name, data))

    def _numbered(self, out: list[tuple[str, dict]]) -> list[tuple[str, dict]]:
        """Events that carry a sequence number are numbered anew, as inserted ones shift them."""
        for i, (name, data) in enumerate(out):
            if "sequence_number" in data:
                self.number = data["sequence_number"] if self.number is None else self.number + 1
                out[i] = (name, data | {"sequence_number": self.number})
        return out

    def _count(self, data: dict) -> None:
        for holder in (data.get("message"), data, data.get("response")):
            if isinstance(holder, dict) and isinstance(holder.get("usage"), dict):
                self.usage |= holder["usage"]

    def _text(self, where) -> TextRestorer:
        return self.texts.setdefault(where, TextRestorer(self.mapping, self.table))

    def _messages(self, name: str, data: dict) -> list[tuple[str, dict]]:
        kind, i = data.get("type"), data.get("index")
        delta = lambda d: ("content_block_delta", {"type": "content_block_delta", "index": i, "delta": d})
        if kind == "content_block_start":
            block = data.get("content_block") or {}
            if block.get("type") == "text":
                first = self._text(i).feed(block.get("text") or "")
                start = (name, data | {"content_block": block | {"text": ""}})
                return [start, delta({"type": "text_delta", "text": first})] if first else [start]
            if block.get("type") == "tool_use" and block.get("name") in self.local:
                self.tools[i] = []
        elif kind == "content_block_delta":
            d = data.get("delta") or {}
            if i in self.texts and d.get("type") == "text_delta":
                out = self._text(i).feed(d.get("text", ""))
                return [(name, data | {"delta": d | {"text": out}})] if out else []
            if i in self.tools and d.get("type") == "input_json_delta":
                self.tools[i].append(d.get("partial_json", ""))
                return []
        elif kind == "content_block_stop" and i in self.texts:
            block = self.texts.pop(i)
            rest = block.finish()
            self.restores.put("text", back(block.text, self.mapping, self.table, prose=True), block.text)
            return [*([delta({"type": "text_delta", "text": rest})] if rest else []), (name, data)]
        elif kind == "content_block_stop" and i in self.tools:
            return [delta({"type": "input_json_delta", "partial_json": self._arguments("".join(self.tools.pop(i)))}), (name, data)]
        return [(name, data)]

    def _arguments(self, raw: str) -> str:
        """A tool's whole arguments in names; what is no JSON stays in tokens."""
        try:
            original = json.loads(raw) if raw.strip() else {}
        except ValueError:
            return raw
        shown = replaced(original, lambda _, s: back(s, self.mapping, self.table))
        self.restores.put("tool_use", shown, original)
        return json.dumps(shown, ensure_ascii=False)

    def _responses(self, name: str, data: dict) -> list[tuple[str, dict]]:
        kind = data.get("type", "")
        where = (data.get("output_index"), data.get("content_index"))
        if kind == "response.output_text.delta":
            out = self._text(where).feed(data.get("delta", ""))
            return [(name, data | {"delta": out})] if out else []
        if kind == "response.output_text.done":
            rest = self._text(where).finish()
            full = back(self.texts.pop(where).text, self.mapping, self.table, prose=True)
            more = [("response.output_text.delta", data | {"type": "response.output_text.delta", "delta": rest})] if rest else []
            return [*more, (name, data | {"text": full})]
        return [(name, data)]

    def flush(self) -> list[tuple[str, dict]]:
        """What is still held of blocks whose end never came."""
        out = []
        for i, block in self.texts.items():
            rest = block.finish()
            if rest and not isinstance(i, tuple):
                out.append(("content_block_delta", {"type": "content_block_delta", "index": i, "delta": {"type": "text_delta", "text": rest}}))
        self.texts.clear()
        return out


STATE = "text string, shown long"
OUTPUT = "stream_id string, block_idx int, seq long, text string"


def restore_stream(deltas: DataFrame, mapping: dict[str, str], timeout: str = "10 minutes") -> DataFrame:
    """A streaming table of text deltas (stream_id, block_idx, seq, delta, final) as names, block by block.

    State: the block's text so far and how much of its restored form has been shown.  Rows of a
    micro-batch are taken in the order of seq; a block whose final row never comes is shown whole when
    it has been idle for `timeout`.
    """
    millis = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, shown = state.get if state.exists else ("", 0)
        block = TextRestorer(mapping, None, text, shown)
        if state.hasTimedOut:
            out, seq, final = block.finish(), -1, True
        else:
            rows = pd.concat(list(frames)).sort_values("seq")
            final = bool(rows["final"].any())
            out, seq = block.feed("".join(rows["delta"].fillna("")), final), int(rows["seq"].max())
        if final:
            state.remove()
        else:
            state.update((block.text, block.shown))
            state.setTimeoutDuration(millis)
        if out:
            yield pd.DataFrame({"stream_id": [group[0]], "block_idx": [group[1]], "seq": [seq], "text": [out]})

    return deltas.groupBy("stream_id", "block_idx").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
