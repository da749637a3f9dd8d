"""Personal data by bootstrapped contextual extraction.

The base finds addresses, card and phone numbers by their form. These are the seeds: the words around them are lexical patterns
of their kind. Other runs of tokens with digits or an at sign are candidates, known to be wrong where a checksum or range says
so. Patterns and the identifiers that stand in them form a graph, which Spark scores in rounds: a pattern by the identifiers
that it meets, an identifier by its patterns. Candidates in the patterns of high confidence are the identifiers that the base
could not see.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import exact, numbered, spread, stored

KINDS = ("email", "ip", "card", "phone")
WRONG, OPEN = -1, -2
#: Lower bound of confidence from which a pattern is trusted, identifiers that it must have met, share of a wrong one that an
#: open candidate counts for, rounds of scoring.
SURE, MET, DOUBT, ROUNDS = 0.7, 3.0, 0.25, 3
#: Characters of a candidate at most, its digits at least, characters to each side that a pattern may see.
LONGEST, DIGITS, SIDE = 40, 5, 64
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN, _DIGIT, _BLANK = re.compile("[0-9]+"), re.compile("[0-9]"), re.compile(r"[\x20\x09-\x0D]")
_BEFORE, _BEHIND = "\"'`<>[]{}*|#$%&=,;:!?.", "\"'`<>[]{}*|#$%&=,;:!?.()"
Span = tuple[int, int]


def _emails(text: str) -> Iterator[Span]:
    """Each at sign is looked at once: the domain after it, and the local part back to the end of what came before."""
    low, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        before = text[low:at] if domain else ""
        n = len(before) - len(before.rstrip(_LOCAL))
        low = at + 1
        if n:
            low = domain.end()
            yield at - n, low
        at = text.find("@", low)


def _chains(text: str, runs: list[Span], between: str) -> Iterator[list[Span]]:
    """Runs of digits that follow each other with one of these characters between them."""
    chain: list[Span] = []
    for run in runs:
        if chain and run[0] == chain[-1][1] + 1 and text[run[0] - 1] in between:
            chain.append(run)
        else:
            if chain:
                yield chain
            chain = [run]
    if chain:
        yield chain


def _luhn(digits: str) -> bool:
    double = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(double) + sum(map(int, digits[-1::-2]))) % 10 == 0


def base(text: str) -> tuple[list[tuple[int, int, int]], list[Span]]:
    """(kind, start, end) of all base matches, by kind and start, and the spans that a range or checksum rules out. The
    time is linear in the text, whatever it holds."""
    found = [(0, a, b) for a, b in _emails(text)]
    runs = [m.span() for m in _RUN.finditer(text)]
    wrong = []
    for chain in _chains(text, runs, "."):
        for i in range(0, len(chain) - 3, 4):
            span = chain[i][0], chain[i + 3][1]
            small = all(b - a <= 3 and int(text[a:b]) <= 255 or len(v := text[a:b].lstrip("0")) <= 3 and int(v or 0) <= 255 for a, b in chain[i : i + 4])
            if small:
                found.append((1, *span))
            else:
                wrong.append(span)
    for chain in _chains(text, runs, " -"):
        if 13 <= sum(b - a for a, b in chain) <= 19:
            if _luhn("".join(text[a:b] for a, b in chain)):
                found.append((2, chain[0][0], chain[-1][1]))
            else:
                wrong.append((chain[0][0], chain[-1][1]))
    found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return found, wrong


def _tokens(text: str, hits: list[int]) -> Iterator[Span]:
    """The tokens between blanks that hold one of these places, in order."""
    end = 0
    for at in hits:
        if at < end:
            continue
        start = end
        for blank in " \n\t\r\x0b\x0c":
            start = max(start, text.rfind(blank, start, at) + 1)
        stop = _BLANK.search(text, at)
        end = stop.start() if stop else len(text)
        yield start, end


def candidates(text: str, taken: list[Span]) -> Iterator[Span]:
    """Runs of neighbouring tokens that hold a digit or an at sign and touch nothing that is taken, without the punctuation
    around them: of at most LONGEST characters, with DIGITS digits or an at sign inside."""
    hits = sorted([m.start() for m in _RUN.finditer(text)] + [m.start() for m in re.finditer("@", text)])
    taken, i, run = sorted(taken), 0, None

    def runs() -> Iterator[Span]:
        nonlocal i, run
        for a, b in _tokens(text, hits):
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            free = i == len(taken) or taken[i][0] >= b
            if run and (not free or a != run[1] + 1 or text[run[1]] != " "):
                yield run
                run = None
            if free:
                run = (run[0] if run else a), b
        if run:
            yield run

    for a, b in runs():
        if b - a > LONGEST + 8:
            continue
        part = text[a:b]
        a += len(part) - len(part.lstrip(_BEFORE))
        part = text[a:b].rstrip(_BEHIND)
        if part.startswith("(") and ")" not in part:
            a, part = a + 1, part[1:]
        if len(part) <= LONGEST and (len(_DIGIT.findall(part)) >= DIGITS or "@" in part[1:-1]):
            yield a, a + len(part)


def _words(side: str) -> list[str]:
    plain = ["".join("0" if c.isdigit() else c for c in w.lower() if c.isalnum()) for w in _BLANK.split(side)]
    return [w for w in plain if w]


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a place: one and two words before it, one and two after it, one on each side."""
    left, right = _words(text[max(0, start - SIDE) : start])[-2:], _words(text[end : end + SIDE])[:2]
    lettered = lambda ws: all(any(c.isalpha() for c in w) for w in ws)
    out = [f"{' '.join(ws)} _" for ws in (left[-1:], left) if len(ws) and lettered(ws)]
    out += [f"_ {' '.join(ws)}" for ws in (right[:1], right) if len(ws) and lettered(ws)]
    if left and right and lettered([left[-1], right[0]]):
        out.append(f"{left[-1]} _ {right[0]}")
    return list(dict.fromkeys(out))


_SPAN = "struct<kind:int,start:int,stop:int>"
_PLACE = "struct<kind:int,start:int,stop:int,name:binary,patterns:array<string>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, _k (a number of the row), base and places of every row: what the base finds, and every seed, ruled out number
    and open candidate with its name (a hash of its text) and its patterns. Stored, so that numbers stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bases, places = [], []
            for text in pdf["text"]:
                found, wrong = base(text)
                known = [*found, *((WRONG, a, b) for a, b in wrong)]
                known += [(OPEN, a, b) for a, b in candidates(text, [(a, b) for _, a, b in known])]
                bases.append([dict(kind=k, start=a, stop=b) for k, a, b in found])
                places.append([dict(kind=k, start=a, stop=b, name=xxhash.xxh3_128_digest(text[a:b].encode()), patterns=patterns(text, a, b)) for k, a, b in known])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "base": bases, "places": places})

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.string()), ("base", _arrow(("kind", "start", "stop"))), ("places", _arrow(("kind", "start", "stop"), [("name", pa.binary()), ("patterns", pa.list_(pa.string()))]))])
        for out in run(pdf.to_pandas() for pdf in batches):
            yield pa.RecordBatch.from_pandas(out, schema=kinds, preserve_index=False)

    rows = docs.select(exact("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = numbered(spread(rows).mapInArrow(batched, f"doc_id string, base array<{_SPAN}>, places array<{_PLACE}>"))
    return stored(found.withColumn("_k", F.monotonically_increasing_id()))


def _arrow(numbers: tuple[str, ...], more: list = ()) -> pa.DataType:
    return pa.list_(pa.struct([*((n, pa.int32()) for n in numbers), *more]))


def _lower(good: Column, all_: Column, z: float = 1.96) -> Column:
    """The lower end of Wilson's interval for the share good / all_."""
    p = good / all_
    spread_ = z * F.sqrt(p * (1 - p) / all_ + z * z / (4 * all_ * all_))
    return (p + z * z / (2 * all_) - spread_) / (1 + z * z / all_)


def trusted(scanned: DataFrame, rounds: int = ROUNDS, sure: float = SURE, met: float = MET, doubt: float = DOUBT) -> DataFrame:
    """pattern, kind, confidence of the patterns of high confidence.

    An edge of the graph is a pattern and a different identifier in it, however often both meet. In each round the confidence
    of a pattern for a kind is the lower bound of its share of identifiers of that kind, where open candidates count by the
    score that they have for each kind and by `doubt` for the rest; the score of an open candidate is that at least one of its
    trusted patterns is right. All sums are made in part before rows are sent.
    """
    seen = scanned.select(F.explode("places").alias("p")).select("p.kind", "p.name", F.explode("p.patterns").alias("pattern"))
    edges = stored(seen.groupBy("pattern", "name", "kind").agg(F.lit(1).alias("one")).drop("one"))
    # what seeds and ruled out numbers say about a pattern stays the same in all rounds
    count = lambda k: F.count_if(F.col("kind") == k)
    fixed = edges.groupBy("pattern").agg(*[count(i).cast("double").alias(k) for i, k in enumerate(KINDS)], count(WRONG).alias("wrong"), count(OPEN).alias("open"))
    fixed = stored(fixed)
    open_ = edges.where(F.col("kind") == OPEN).select("pattern", "name")
    names: DataFrame | None = None
    best = None
    for _ in range(rounds):
        now = fixed
        if names is not None:
            told = open_.join(names, "name").groupBy("pattern").agg(*[F.sum(k).alias(f"s_{k}") for k in KINDS])
            now = now.join(told, "pattern", "left")
            now = now.withColumns({k: F.col(k) + F.coalesce(f"s_{k}", F.lit(0.0)) for k in KINDS} | {"scored": sum((F.coalesce(f"s_{k}", F.lit(0.0)) for k in KINDS), F.lit(0.0))})
        else:
            now = now.withColumn("scored", F.lit(0.0))
        kinds = sum((F.col(k) for k in KINDS), F.lit(0.0))
        rest = F.greatest(F.col("open") - F.col("scored"), F.lit(0.0))
        now = now.withColumn("all", kinds + F.col("wrong") + doubt * rest)
        each = now.select("pattern", "all", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("good")) for i, k in enumerate(KINDS)])).alias("x")).select("pattern", "all", "x.*")
        best = stored(each.where(F.col("good") >= met).select("pattern", "kind", _lower(F.col("good"), F.col("all")).alias("confidence")).where(F.col("confidence") >= sure))
        doubts = F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))
        scores = open_.join(best, "pattern").groupBy("name").agg(*[(1 - F.exp(F.sum(F.when(F.col("kind") == i, doubts).otherwise(0.0)))).alias(k) for i, k in enumerate(KINDS)])
        total = sum((F.col(k) for k in KINDS), F.lit(0.0))
        names = scores.select("name", *[(F.col(k) / F.greatest(total, F.lit(1.0))).alias(k) for k in KINDS])
    return best


def _text(spans: str) -> Column:
    """kind:start:end of an array of spans, by kind and start, joined by commas."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _is(kind: int):
    return lambda span: span["kind"] == kind


def personal_data(docs: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """Base matches and discovered identifiers of every row: doc_id, n_email, n_ip, n_card, n_phone (base matches, long),
    n_added (discovered ones, long), base_sha256 (of the base spans as text), spans (all, as text: kind:start:end in code
    points, by kind and start, joined by commas).

    A discovered identifier has the kind of the trusted pattern in which it stands, of several the one of most confidence (ties:
    the first kind). It is marked where such a pattern stands and touches no base match. A null text is empty and has no spans. Rows that
    repeat a doc_id, or have none, are each returned; patterns count different identifiers, so copies of a text weigh
    nothing. Texts may be of any length. Other columns than doc_id and text are not looked at; no rows give no rows.
    """
    scanned = scan(docs)
    best = trusted(scanned, rounds, sure)
    open_ = scanned.select("_k", F.explode("places").alias("p")).where(F.col("p.kind") == OPEN)
    open_ = open_.select("_k", "p.start", "p.stop", F.explode("p.patterns").alias("pattern"))
    found = open_.join(best, "pattern").groupBy("_k", "start", "stop").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("less"))).alias("m"))
    added = found.groupBy("_k").agg(F.collect_list(F.struct((-F.col("m.less")).alias("kind"), "start", "stop")).alias("added"))
    rows = scanned.drop("places").join(added, "_k", "left").withColumn("added", F.coalesce("added", F.array().cast(f"array<{_SPAN}>")))
    rows = rows.withColumn("spans", F.concat("base", "added"))
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.size("added").cast("long").alias("n_added"), F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"))
