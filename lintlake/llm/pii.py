"""Personal data: fixed patterns as seeds, then contexts that the seeds share find further identifiers."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.llm import common

KINDS = ("email", "ip", "card", "phone")
#: Distinct seeds that a pattern needs, rounds of scoring, and the confidence from which an instance is reported.
MIN_SEEDS = 3
ROUNDS = 3
CONFIDENT = 0.7
#: Instances of doubtful value that each pattern is assumed to have besides those seen.
DOUBT = 1.0

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"\S+")
#: A word of digits, brackets and separators; runs of such words, as phones and cards are written; a spelt-out address.
_PART = re.compile(r"\(?[0-9](?:[().+/-]*[0-9])*\)?")
_RUN = re.compile(
    rf"(?<![^\s=:\"'<\[{{,;(])\+?{_PART.pattern}(?:[ \t]+(?:[-/.][ \t]+)?{_PART.pattern})+(?![^\s.,;:!?)\]}}>\"'<])"
)
_SPELT = re.compile(r"(?<!\S)[A-Za-z0-9._%+-]+ at [A-Za-z0-9-]+(?:(?:\.| dot )[A-Za-z0-9-]+)*(?:\.| dot )[A-Za-z]{2,}")
#: Characters of its own word before an occurrence that are part of its patterns, at most (the last ones).
KEY = 24
#: Characters of a neighbouring word in a pattern, at most.
NEIGHBOUR = 64
#: Digits of a run that is one candidate.
RUN_DIGITS = (7, 19)
_EDGE = ".,;:!?()[]{}<>\"'"
_SPAN = "struct<start:int,kind_no:int,stop:int>"
_SCAN = (
    f"doc_id long, a long, b long, base array<{_SPAN}>, "
    "seen array<struct<start:int,stop:int,kind_no:int,instance:string,patterns:array<string>>>"
)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each address ends in a domain; its local part is the run of allowed characters before the @."""
    end = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        if start < m.start():
            yield start, m.end()
            end = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base matches, sorted."""
    if not _ANY.search(text):
        return []
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(x[-4:]) <= 255 and (len(x) <= 3 or not x[:-3].strip("0")) for x in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _shape(value: str) -> str:
    if "@" in value or " at " in value:
        return "at"
    letters = any(c.isalpha() for c in value)
    return "mixed" if letters else "dotted" if value.count(".") >= 2 else "digits"


def _runs(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring number words outside of the spans; one with too many digits is cut between words."""
    at = 0
    for m in _RUN.finditer(text):
        group, digits = [], 0
        groups = [group]
        for part in _PART.finditer(text, m.start(), m.end()):
            n = sum(c in "0123456789" for c in part.group())
            while at < len(spans) and spans[at][2] <= part.start():
                at += 1
            if at < len(spans) and spans[at][0] < part.end():
                group, digits = [], 0
                groups.append(group)
                continue
            if digits + n > RUN_DIGITS[1]:
                group, digits = [], 0
                groups.append(group)
            group.append(part.span())
            digits += n
        for group in groups:
            if len(group) < 2:
                continue
            start, stop = group[0][0], group[-1][1]
            if text[start] == "(" and ")" not in text[start : stop - 1]:
                start += 1
            if text[stop - 1] == ")" and text.count("(", start, stop) < text.count(")", start, stop):
                stop -= 1
            if start > m.start() and text[start - 1] == "+":
                start -= 1
            if sum(c in "0123456789" for c in text[start:stop]) >= RUN_DIGITS[0]:
                yield start, stop


def _occurrences(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """Seeds, and identifier-like words and runs of words outside of them, each with the patterns of its context."""
    spelt = list(_SPELT.finditer(text)) if " at " in text else []
    if not spelt and not _ANY.search(text):
        return []
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    plain = [text[s : min(e, s + NEIGHBOUR)].lower().strip(_EDGE) for s, e in words]
    out, taken, at = [], 0, 0
    runs = list(_runs(text, spans))
    runs += [m.span() for m in spelt if not any(s < m.end() and m.start() < e for s, _, e in spans)]

    def add(start: int, stop: int, kind: int, first: int, last: int) -> None:
        value = text[start:stop]
        before = [plain[i] if i >= 0 else "^" for i in (first - 2, first - 1)]
        after = plain[last + 1] if last + 1 < len(plain) else "$"
        key = text[max(words[first][0], start - KEY) : start].lower().lstrip(_EDGE)
        shape = _shape(value)
        patterns = [f"2 {before[0]} {before[1]} {key}|{shape}", f"1 {before[1]} {key}_{after}|{shape}"]
        if key:
            patterns.append(f"0 {key}|{shape}")
        out.append((start, stop, kind, value, patterns))

    for i, (s, e) in enumerate(words):
        while at < len(spans) and spans[at][0] < e:
            start, kind, stop = spans[at]
            at += 1
            last = i
            while last + 1 < len(words) and words[last + 1][0] < stop:
                last += 1
            add(start, stop, kind, i, last)
            taken = max(taken, stop)
        if s < taken or e - s < 5 or not _ANY.search(text, s, e):
            continue
        cut = max(text.rfind("=", s, e), text.rfind(":", s, e)) + 1
        start = max(s, cut)
        while start < e and text[start] in _EDGE:
            start += 1
        stop = e
        while stop > start and text[stop - 1] in _EDGE:
            stop -= 1
        if stop - start >= 5 and _ANY.search(text, start, stop):
            add(start, stop, -1, i, i)
    starts = [s for s, _ in words]
    for start, stop in runs:
        add(start, stop, -1, bisect_right(starts, start) - 1, bisect_right(starts, stop - 1) - 1)
    return out


def scan(documents: DataFrame) -> DataFrame:
    """One pass over the texts: base spans, and the occurrences that take part in bootstrapping."""

    def work(columns: list[pa.Array]) -> dict[str, object]:
        base, seen = [], []
        for text in columns[3].to_pylist():
            text = text or ""
            spans = base_spans(text)
            base.append([{"start": s, "kind_no": k, "stop": e} for s, k, e in spans])
            seen.append([dict(zip(("start", "stop", "kind_no", "instance", "patterns"), o, strict=True)) for o in _occurrences(text, spans)])
        span = pa.struct([("start", pa.int32()), ("kind_no", pa.int32()), ("stop", pa.int32())])
        occurrence = pa.struct([
            ("start", pa.int32()), ("stop", pa.int32()), ("kind_no", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string())),
        ])
        return {
            "doc_id": columns[0], "a": columns[1], "b": columns[2], "base": pa.array(base, pa.list_(span)),
            "seen": pa.array(seen, pa.list_(occurrence)),
        }

    body = F.coalesce("text", F.lit(""))
    keyed = documents.select("doc_id", F.xxhash64("doc_id", body).alias("a"), F.xxhash64(body, "doc_id").alias("b"), "text")
    return common.stored(common.map_columns(keyed, ["doc_id", "a", "b", "text"], _SCAN, work))


def pattern_scores(occurrences: DataFrame) -> DataFrame:
    """(pattern, kind_no, score) after some rounds over the graph of patterns and instances.

    Edges are distinct (pattern, instance) pairs. Seeds have confidence 1 in their kind. A pattern's score for a kind is
    the mean confidence of its instances, with ``DOUBT`` worthless ones added; an instance's confidence is
    the chance that at least one of its patterns is right. Patterns with fewer than ``MIN_SEEDS`` distinct seeds
    never count.
    """
    edges = occurrences.select("instance", "kind_no", F.explode("patterns").alias("pattern")).distinct()
    seeds = edges.filter("kind_no >= 0").groupBy("pattern", "kind_no").agg(F.count(F.lit(1)).alias("seeds"))
    enough = common.stored(seeds.filter(F.col("seeds") >= MIN_SEEDS))
    kept = common.stored(edges.join(enough.select("pattern").distinct(), "pattern", "left_semi"))
    sizes = kept.groupBy("pattern").agg(F.countDistinct("instance").alias("size"))
    allowed = common.stored(enough.join(sizes, "pattern").select("pattern", "kind_no", "seeds", "size"))
    score = F.col("seeds") / (F.col("size") + F.lit(DOUBT))
    scores = allowed.select("pattern", "kind_no", score.alias("score"))
    unknown = kept.filter("kind_no < 0").select("pattern", "instance")
    for _ in range(ROUNDS - 1):
        doubt = F.exp(F.sum(F.log(F.lit(1.0) - F.least("score", F.lit(0.999)))))
        found = unknown.join(scores, "pattern").groupBy("instance", "kind_no").agg((1 - doubt).alias("confidence"))
        gained = unknown.join(found, "instance").groupBy("pattern", "kind_no").agg(F.sum("confidence").alias("gained"))
        scores = common.stored(
            allowed.join(gained, ["pattern", "kind_no"], "left").select(
                "pattern", "kind_no",
                ((F.col("seeds") + F.coalesce("gained", F.lit(0.0))) / (F.col("size") + F.lit(DOUBT))).alias("score"),
            )
        )
    return scores


def find(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of base matches, digest of the base spans, all spans.

    A null text is empty. An occurrence outside the base spans is added, in the kind its patterns speak for, where their
    joint confidence is ``CONFIDENT``; one that lies inside another added one is part of it. Rows that repeat a document get the same spans each.
    """
    scanned = scan(documents)
    seen = scanned.select("a", "b", F.explode("seen").alias("o")).select("a", "b", "o.*")
    scores = pattern_scores(seen)
    doubt = F.exp(F.sum(F.log(F.lit(1.0) - F.least("score", F.lit(0.999)))))
    before = Window.partitionBy("a", "b").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    new = (
        seen.filter("kind_no < 0").dropDuplicates(["a", "b", "start", "stop"])
        .select("a", "b", "start", "stop", F.explode("patterns").alias("pattern")).join(scores, "pattern")
        .groupBy("a", "b", "start", "stop", "kind_no").agg((1 - doubt).alias("confidence"))
        .groupBy("a", "b", "start", "stop").agg(F.max(F.struct("confidence", -F.col("kind_no"))).alias("best"))
        .select("a", "b", "start", "stop", "best.confidence", F.struct("start", (-F.col("best.col2")).cast("int").alias("kind_no"), "stop").alias("span"))
        .filter(F.col("confidence") >= CONFIDENT)
        .withColumn("reached", F.max("stop").over(before)).filter(F.col("reached").isNull() | (F.col("reached") < F.col("stop")))
        .groupBy("a", "b").agg(F.collect_list("span").alias("added"))
    )
    names = F.array(*[F.lit(k) for k in KINDS])

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind_no"]], s["start"], s["stop"])), ",")

    rows = scanned.select("doc_id", "a", "b", "base").join(new, ["a", "b"], "left")
    of_kind = F.col("base.kind_no")
    counts = [(F.size("base") - F.size(F.array_remove(of_kind, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    everything = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{_SPAN}>"))))
    return rows.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(everything).alias("spans"))


