"""Personal data by bootstrapped contextual extraction.

A first pass finds the base entities by their forms, and loosely formed candidates that no base entity
covers; it keeps the lexical context of both. Base entities are the seeds. Contexts (two words before;
one word before and one after) are patterns. In each round a pattern's score for a kind is the share
of trusted instances of that kind among all distinct instances it surrounds, if enough distinct ones
support it; an instance's confidence is the chance that one of its patterns is right. Candidates that
reach the threshold support patterns in the next round, and in the end their occurrences are found.

Only distinct (pattern, instance) pairs take part, after counting by key, so a context or a string
that fills the corpus is one row or one key; rows of documents never meet.

Defined results: a null text is empty and has no entity; spans are code points, end exclusive; a
discovered span never touches a base span; rows are handled one by one, repeated ones alike; an empty
table gives an empty result; other columns are kept if asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlens.llm.common import arrow_rows, cut

#: Kinds in the order of results.
KINDS = ("email", "ip", "card", "phone")
ROUNDS, SUPPORT, LEAST_SCORE, LEAST_CONFIDENCE = 3, 3, 0.8, 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r" ?(?:@|\(at\)|\[at\]) ?")
_LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)*")
_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9])+")
_DIGITS = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _run_before(text: str, at: int, least: int) -> int:
    """Start of the run of address characters that ends at ``at``, not before ``least``."""
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def base_entities(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of base entities, by kind, then start. Every scan is linear in the text."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = _run_before(text, at, end)
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGITS.search(text):
        return out
    for found in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found[0].split(".")):
            out.append((1, found.start(), found.end()))
    for found in _CARD.finditer(text):
        if 16 <= found.end() - found.start() and 16 <= len(digits := re.sub("[^0-9]", "", found[0])) <= 19 and _luhn(digits):
            out.append((2, found.start(), found.end()))
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 8 <= len(_DIGITS.findall(found[0])) <= 15:
                out.append((3, found.start(), found.end()))
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Loosely formed entities that no base entity touches."""
    taken = sorted((a, b) for _, a, b in base)
    out, place = [], 0
    found = []
    end = 0
    if "@" in text or "(at)" in text or "[at]" in text:
        for at in _AT.finditer(text):
            start = _run_before(text, at.start(), end)
            rest = _LOOSE_DOMAIN.match(text, at.end()) if start < at.start() else None
            if rest:
                end = rest.end()
                found.append((0, start, end))
    for number in _NUMBER.finditer(text):
        size = len(_DIGITS.findall(number[0]))
        if 7 <= size <= 19:
            kind = 1 if number[0].count(".") == 3 and size <= 12 else 2 if size >= 13 else 3
            found.append((kind, number.start(), number.end()))
    for kind, a, b in sorted(found, key=lambda f: f[1]):
        while place < len(taken) and taken[place][1] <= a:
            place += 1
        if place == len(taken) or taken[place][0] >= b:
            out.append((kind, a, b))
    return out


def _word(word: str) -> str:
    return _DIGITS.sub("0", word.lower())[:24]


def contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns around a span: two words before it, and one before and one after it."""
    before = [_word(w) for w in text[max(0, start - 100):start].split()[-2:]]
    after = [_word(w) for w in text[end:end + 60].split()[:1]]
    before = ["^"] * (2 - len(before)) + before
    return [f"{before[0]} {before[1]} _", f"{before[1]} _ {(after or ['$'])[0]}"]


def surface(text: str, kind: int, start: int, end: int) -> str:
    """The form under which occurrences count as one instance."""
    own = text[start:end].lower()
    return own if kind < 2 else re.sub("[^0-9]", "", own)


def _occurrences(docs: DataFrame, keep: list[str]) -> DataFrame:
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            texts = columns["text"]
            for at in range(0, len(texts), 1000):
                counts, spans, found = [], [], []
                for text in (t or "" for t in texts[at:at + 1000].to_pylist()):
                    base = base_entities(text)
                    loose = candidates(text, base) if base or "@" in text or "(at)" in text or "[at]" in text or _DIGITS.search(text) else []
                    counts.append([sum(b[0] == k for b in base) for k in range(len(KINDS))])
                    spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                    found.append([{"kind": k, "start": a, "end": b, "seed": seed, "instance": surface(text, k, a, b), "patterns": contexts(text, a, b)}
                                  for seed, group in ((True, base), (False, loose)) for k, a, b in group])
                yield ({c: columns[c][at:at + 1000] for c in keep} | {"_counts": counts, "_base": spans, "_found": found})

    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + ["_counts array<long>", "_base array<struct<kind:int,start:int,end:int>>",
                       "_found array<struct<kind:int,start:int,end:int,seed:boolean,instance:string,patterns:array<string>>>"])
    return arrow_rows(docs.select(*dict.fromkeys([*keep, "text"])), run, schema)


def discover(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, least_score: float = LEAST_SCORE, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(kind, instance, confidence) of candidates that the pattern-instance graph supports, from ``found`` (kind, instance, seed, patterns)."""
    edges = found.select("kind", "instance", "seed", F.explode("patterns").alias("pattern")).distinct()
    loose = cut(edges.where("not seed").select("kind", "instance", "pattern"))
    seeds = cut(edges.where("seed").groupBy("pattern", "kind").agg(F.count("*").alias("n"))
                .join(loose.select("pattern").distinct(), "pattern", "left_semi"))
    trusted = None
    for _ in range(rounds):
        own = loose.withColumn("mass", F.lit(0.0))
        if trusted is not None:
            own = loose.join(trusted, ["kind", "instance"], "left").select("kind", "instance", "pattern", F.coalesce("confidence", F.lit(0.0)).alias("mass"))
        sums = (own.groupBy("pattern", "kind").agg(F.sum("mass").alias("mass"), F.count("*").alias("n"))
                .unionByName(seeds.select("pattern", "kind", F.col("n").cast("double").alias("mass"), "n"))
                .groupBy("pattern", "kind").agg(F.sum("mass").alias("mass"), F.sum("n").alias("n")))
        whole = sums.groupBy("pattern").agg(F.sum("n").alias("all"))
        good = (sums.join(whole, "pattern").where((F.col("mass") >= support) & (F.col("mass") >= least_score * F.col("all")))
                .select("pattern", "kind", (F.col("mass") / F.col("all")).alias("score")))
        trusted = cut(loose.join(good, ["pattern", "kind"]).groupBy("kind", "instance")
                      .agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("confidence")).where(F.col("confidence") >= least_confidence))
    return trusted


def detect(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with _counts (by kind), _base and _spans (arrays of kind, start, end by kind, then start), from ``text``."""
    rows = cut(_occurrences(docs, keep).withColumn("_row", F.monotonically_increasing_id()))
    found = rows.select("_row", F.inline("_found"))
    trusted = discover(found)
    more = (found.where("not seed").join(trusted, ["kind", "instance"]).groupBy("_row")
            .agg(F.collect_list(F.struct("kind", "start", "end")).alias("_more")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    # only rows with candidates meet the join; the others, with their texts, stay where they are
    loose = F.exists("_found", lambda x: ~x["seed"])
    met = rows.where(loose).join(more, "_row", "left").unionByName(rows.where(~loose).withColumn("_more", none))
    return met.withColumn("_spans", F.array_sort(F.concat("_base", F.coalesce("_more", none)))).drop("_found", "_row", "_more")


def listed(spans: str):
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets; overlapping spans become one."""
    columns = docs.columns
    found = detect(docs, columns)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for own in batches:
            texts = []
            for text, spans in zip(own["text"].to_pylist(), own["_spans"].to_pylist()):
                if text is not None and spans:
                    parts, at = [], 0
                    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                        if s["start"] >= at:
                            parts += [text[at:s["start"]], f"[{KINDS[s['kind']].upper()}]"]
                        at = max(at, s["end"])
                    text = "".join(parts) + text[at:]
                texts.append(text)
            yield {c: own[c] for c in columns} | {"text": texts}

    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return arrow_rows(found, run, ", ".join(f"`{c}` {fields[c]}" for c in columns))


def digests(docs: DataFrame) -> DataFrame:
    found = detect(docs, ["doc_id"])
    return found.select("doc_id", *[F.get("_counts", F.lit(i)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(listed("_base"), 256).alias("base_sha256"), listed("_spans").alias("spans"))
