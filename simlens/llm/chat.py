"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once with offsets; the sorted character spans of the
assistant's texts are intersected with the sorted token spans by binary search, which gives the mask.

The template marks turns by control strings, which are tokens of their own and never join with text.
Control strings inside texts get a backslash after their first character, and one more where they
have some already, so that the escape can be undone exactly.

Rows are dealt by conversation and sorted by turn; a task streams through them and writes segments of
bounded length, cut between turns, so a conversation of any length passes with little memory.

Defined results: rows are ordered by turn, then role and text, nulls first; a null text or role is
empty; a null conversation id is a conversation of its own; repeated rows are repeated turns; an empty
table gives nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlens.llm.common import arrow_rows, cut, worker_state

#: Control strings: what opens and closes the turns of each role; other roles are named in the opening.
OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
OTHER_OPEN, OTHER_NAMED, OTHER_CLOSE = "[ROLE=", "[IS]", "[/ROLE]"
CONTROLS = [*OPEN.values(), *CLOSE.values(), OTHER_OPEN, OTHER_NAMED, OTHER_CLOSE]
#: Characters after which a segment is closed at the next turn.
SEGMENT = 1 << 20


def _patterns(special: list[str]) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    names = sorted({*CONTROLS, *special}, key=len, reverse=True)
    heads = "".join(re.escape(h) for h in sorted({n[0] for n in names}))
    tails = "|".join(re.escape(n[1:]) for n in names if len(n) > 1)
    control = re.compile("|".join(re.escape(n) for n in names))
    return control, re.compile(rf"([{heads}])(\\*)(?={tails})"), re.compile(rf"([{heads}])\\(\\*)(?={tails})")


class Template:
    """Rendering, escaping and reading back; ``special`` are control strings of the tokenizer."""

    def __init__(self, special: list[str] = ()):
        self.control, self._escape, self._unescape = _patterns(list(special))

    def escape(self, text: str) -> str:
        return self._escape.sub(r"\1\\\2", text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(r"\1\2", text)

    def turn(self, role: str, text: str) -> tuple[str, str, str]:
        """What stands before, in and after the text."""
        if role in OPEN:
            return OPEN[role], self.escape(text), CLOSE[role]
        return OTHER_OPEN + quote(role, safe="") + OTHER_NAMED, self.escape(text), OTHER_CLOSE

    def turns(self, formatted: str) -> Iterator[tuple[str, str, int, int]]:
        """Role, unescaped text, and the span of the escaped text, of each turn of a rendered segment."""
        roles = {v: k for k, v in OPEN.items()}
        at = 0
        while at < len(formatted):
            opening = self.control.match(formatted, at)
            if opening[0] == OTHER_OPEN:
                named = formatted.index(OTHER_NAMED, at)
                role, start, close = unquote(formatted[opening.end():named]), named + len(OTHER_NAMED), OTHER_CLOSE
            else:
                role, start = roles[opening[0]], opening.end()
                close = CLOSE[role]
            end = formatted.index(close, start)
            yield role, self.unescape(formatted[start:end]), start, end
            at = end + len(close)


def intersect(spans: list[tuple[int, int]], offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """Token number, start and end of the common part of each token with the sorted, disjoint spans."""
    if not spans or not len(offsets):
        return []
    out = []
    starts, ends = offsets[:, 0], offsets[:, 1]
    for start, end in spans:
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(starts, end, "left")
        for i in range(int(first), int(last)):
            a, b = max(start, int(starts[i])), min(end, int(ends[i]))
            if a < b:
                out.append((i, a, b))
    return out


class ChatEncoder:
    """A tokenizer that knows the control strings."""

    def __init__(self, path: str):
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        own = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.add_special_tokens([AddedToken(c, normalized=False) for c in CONTROLS])
        self.template = Template(own)

    def encode(self, turns: list[tuple[str, str]]) -> tuple[str, list[int], list[tuple[int, int, int]]]:
        """The rendered turns, their ids, and the masked parts of tokens."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            before, inner, after = self.template.turn(role, text)
            parts += [before, inner, after]
            if role == "assistant":
                spans.append((at + len(before), at + len(before) + len(inner)))
            at += len(before) + len(inner) + len(after)
        formatted = "".join(parts)
        made = self.tokenizer.encode(formatted, add_special_tokens=False)
        return formatted, made.ids, intersect(spans, np.array(made.offsets, dtype=np.int64).reshape(-1, 2))


def format_conversations(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Segments of formatted conversations from ``turns`` (conv_id, turn, role, text).

    conv_id, segment, formatted, ids, and the mask: token numbers with the character span of each that counts for the loss.
    """
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = worker_state(f"chat {tokenizer}", lambda: ChatEncoder(tokenizer))
        open_id, held, size, segment, begun = None, [], 0, 0, False
        done: list[tuple] = []

        def close():
            nonlocal held, size, segment
            formatted, ids, mask = encoder.encode(held)
            done.append((open_id, segment, formatted, ids, [m[0] for m in mask], [m[1] for m in mask], [m[2] for m in mask]))
            held, size, segment = [], 0, segment + 1

        def flush():
            rows = {n: [d[i] for d in done] for i, n in enumerate(("conv_id", "segment", "formatted", "ids", "mask_token", "mask_start", "mask_end"))}
            done.clear()
            return rows

        for columns in batches:
            for ident, role, text in zip(*(columns[c].to_pylist() for c in ("conv_id", "role", "text"))):
                if begun and (ident != open_id or size >= SEGMENT):
                    close()
                if not begun or ident != open_id:
                    open_id, segment, begun = ident, 0, True
                held.append((role or "", text or ""))
                size += len(text or "")
                if len(done) >= 256:
                    yield flush()
        if begun:
            close()
        if done:
            yield flush()

    dealt = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return arrow_rows(dealt, run, "conv_id long, segment int, formatted string, ids array<int>, mask_token array<int>, mask_start array<int>, mask_end array<int>")


def read_back(segments: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of each conversation from its formatted segments and masks."""
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        template = worker_state(f"chat {tokenizer}", lambda: ChatEncoder(tokenizer)).template
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        state, rows = None, []

        def result():
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        for columns in batches:
            for ident, formatted, starts, ends in zip(*(columns[c].to_pylist() for c in ("conv_id", "formatted", "mask_start", "mask_end"))):
                if state is None or state[0] != ident:
                    if state is not None:
                        rows.append(result())
                    state = [ident, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[5] += len(formatted)
                marked, covered = 0, 0
                for role, text, start, end in template.turns(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    parts, covered = [], max(covered, start)
                    while marked < len(starts) and starts[marked] < end:
                        if ends[marked] > covered:      # tokens that share a character count it once
                            parts.append(formatted[max(starts[marked], covered):ends[marked]])
                            covered = ends[marked]
                        marked += 1
                    under = template.unescape("".join(parts))
                    state[3] += len(under)
                    state[4].update(under.encode("utf-8", "surrogatepass"))
            yield {n: [r[i] for r in rows] for i, n in enumerate(names)}
            rows = []
        if state is not None:
            yield {n: [v] for n, v in zip(names, result())}

    dealt = segments.select("conv_id", "segment", "formatted", "mask_start", "mask_end").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return arrow_rows(dealt, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_digests(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Format, write, and read back."""
    return read_back(cut(format_conversations(turns, tokenizer)), tokenizer)
