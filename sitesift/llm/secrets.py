r"""Secret scans [native].

Three fixed patterns, and runs of key-like characters whose Shannon entropy
in some window of 20 characters is high for their character class. The window
slides with incremental counts: one count goes up and one goes down, and the
sum of c log2 c follows. All is one projection over the text, without a shuffle.

Defined cases: a null text is empty; texts of any length are scanned whole;
positions are code points, ends exclusive; spans of different kinds may overlap.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the three base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Character classes, narrowest first, and the bits a window needs in each.
CLASSES = ((r"^[0-9A-Fa-f]+$", 3.0), (r"^[0-9A-Za-z]+$", 3.7), (r"^.+$", 3.9))
#: Runs that are known to be harmless: one character class only, or documentation values.
ALLOWED = r"^([0-9]+|[A-Za-z]+|[^A-Za-z0-9]+)=*$|EXAMPLE|[Ee]xample|[Pp]laceholder|[Xx]{6}|[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
#: The same in two: what judges a whole run, and what lets only the windows go that meet it.
WHOLE, PART = ALLOWED.split("|EXAMPLE|", 1)[0], "EXAMPLE|" + ALLOWED.split("|EXAMPLE|", 1)[1]
#: c log2 c in millionths, so that sums are exact.
TERMS = [0, *(round(c * math.log2(c) * 1e6) for c in range(1, WINDOW + 1))]


def most_sum(bits: float) -> int:
    """Largest sum of c log2 c (millionths) at which a window still has ``bits`` of entropy."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * 1e6)


def matches(text: Column, pattern: str, shortest: int, group: int = 0) -> Column:
    """array<struct<start,end,text>>: leftmost matches with ``group`` of ``shortest`` characters or more."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    rows = F.arrays_zip(gaps.alias("gap"), found.alias("found"), judged.alias("judged"))
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,text:string>>)")

    def add(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["gap"])
        end = start + F.length(row["found"])
        kept = F.when(F.length(row["judged"]) >= shortest, F.concat(state["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), row["found"].alias("text"))))).otherwise(state["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    listed = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda s: s["out"])
    return F.when(F.rlike(text, F.lit(pattern)), listed).otherwise(empty)


def hot_windows(run: Column) -> Column:
    """array<struct<start,end>> inside ``run``: joined windows with enough entropy for its class that meet no harmless part."""
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c))
    limit = F.lit(most_sum(CLASSES[-1][1]))
    for pattern, bits in reversed(CLASSES[:-1]):
        limit = F.when(F.rlike(run, F.lit(pattern)), most_sum(bits)).otherwise(limit)
    terms = F.array(*[F.lit(t) for t in TERMS])
    none = F.expr("CAST(array() AS array<struct<start:int,end:int>>)")
    parts = F.transform(matches(run, PART, 1), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))

    def step(state: Column, i: Column) -> Column:
        come = F.get(state["codes"], i)
        go = F.when(i >= WINDOW, F.get(state["codes"], i - WINDOW)).otherwise(F.lit(-1))
        of_come, of_go = F.get(state["counts"], come), F.get(state["counts"], go)
        change = F.when(come == go, 0).otherwise(
            F.get(terms, of_come + 1) - F.get(terms, of_come)
            + F.when(go >= 0, F.get(terms, of_go - 1) - F.get(terms, of_go)).otherwise(0))
        counts = F.transform(state["counts"], lambda c, j: c + F.when(j == come, 1).otherwise(0) - F.when(j == go, 1).otherwise(0))
        total = (state["total"] + change).cast("int")
        start, end = i - (WINDOW - 1), i + 1
        harmless = F.exists(state["parts"], lambda p: (p["start"] < end) & (p["end"] > start))
        hot = (i >= WINDOW - 1) & (total <= state["limit"]) & ~harmless
        last = F.get(state["out"], F.size(state["out"]) - 1)
        joined = F.concat(F.slice(state["out"], 1, F.size(state["out"]) - 1), F.array(F.struct(last["start"].alias("start"), end.alias("end"))))
        added = F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        out = F.when(~hot, state["out"]).when((F.size(state["out"]) > 0) & (last["end"] >= start), joined).otherwise(added)
        return F.struct(state["codes"].alias("codes"), counts.alias("counts"), total.alias("total"),
                        state["limit"].alias("limit"), state["parts"].alias("parts"), out.alias("out"))

    # The codes travel in the state: an expression outside would be evaluated anew in every step.
    first = F.struct(codes.alias("codes"), F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0).alias("total"),
                     limit.cast("int").alias("limit"), parts.alias("parts"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.length(run) - 1), first, step, lambda s: s["out"])


def secret_spans(text: Column) -> dict[str, Column]:
    """Arrays of (start, kind number, end) by kind; ``text`` must not be null."""
    base = {"assign": matches(text, ASSIGN, 6, 2), "access": matches(text, ACCESS, 20), "hex": matches(text, HEX, 24)}
    runs = F.filter(matches(text, RUN, WINDOW), lambda r: ~F.rlike(r["text"], F.lit(WHOLE)))
    entropy = F.flatten(F.transform(runs, lambda r: F.transform(hot_windows(r["text"]), lambda w: F.struct(
        (r["start"] + w["start"]).alias("start"), (r["start"] + w["end"]).alias("end")))))

    def numbered(spans: Column, number: int) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))

    return {kind: numbered(base.get(kind, entropy), number) for number, kind in enumerate(KINDS)}


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with ``secrets``: the four span arrays."""
    spans = secret_spans(F.coalesce(F.col(text), F.lit("")))
    return documents.withColumn("secrets", F.struct(*[c.alias(k) for k, c in spans.items()]))


def scan_digest(documents: DataFrame) -> DataFrame:
    found = scan(documents.select("doc_id", "text")).select("doc_id", "secrets")
    base = F.concat("secrets.assign", "secrets.access", "secrets.hex")
    return found.select(
        "doc_id", *[F.size(f"secrets.{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, "secrets.entropy")).alias("spans"))


def redact(documents: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Every found span replaced by ``mark``; spans that overlap or touch count as one. Same columns."""
    packed = documents.select(F.struct("*").alias("doc"), F.col(text).alias("text"))
    spans = F.array_sort(F.concat(*[F.col(f"secrets.{k}") for k in KINDS]))
    found = scan(packed).select("doc", "text", spans.alias("spans"))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(state: Column, s: Column) -> Column:
        gap = F.substr(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        fresh = (s["start"] > state["at"]) | (state["out"] == "")
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"))

    clean = F.aggregate("spans", first, cut, lambda s: F.concat(s["out"], F.substr(F.col("text"), s["at"] + 1)))
    body = F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))
    return found.select(*[body.alias(c) if c == text else F.col(f"doc.`{c}`") for c in documents.columns])
