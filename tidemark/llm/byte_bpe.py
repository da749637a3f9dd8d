"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside Spark tasks.

A task keeps an in-memory DuckDB with the vocabulary and the merge table. The distinct pre-tokens of a batch become
token-position rows; a recursive query joins neighbours with the merge table and contracts each word's leftmost pair of
smallest rank until none is left. An ordered aggregation lists a word's ids and joins the bytes that the vocabulary has for
them; texts are put together from that.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import exact, numbered, spread

#: Bytes that a task's memory of words and stretches may take, by estimate; stretches above so many characters are forgotten.
_HELD, _BRIEF = 250_000_000, 200
#: Words of one recursive query; words above so many bytes go to the keyed query, so many bytes at once, for at most so many
#: rows times rounds before its state is stored and the query starts anew.
_WORDS, _SHORT, _LONG_BYTES, _STEPS = 10_000, 64, 1 << 15, 600_000
#: Characters of texts whose stretches are learned together, and above which a text is taken in parts.
_BATCH, _PART = 8_000_000, 1 << 20
#: Two white-space characters in a row or one at an end, by any reading of white space: such texts are cut by the pattern.
_LOOSE = regex.compile(r"[\s\x1c-\x1f\x85]{2}|^[\s\x1c-\x1f\x85]|[\s\x1c-\x1f\x85]$")
#: ASCII white space as spaces; how characters begin in UTF-8 among which there is other white space.
_FLAT = bytes(32 if 9 <= b <= 13 or 28 <= b <= 31 else b for b in range(256))
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")
#: A place where the pattern must begin a match.
_JOINT = re.compile(r"(?<=[!-~]) (?=[!-~])")

_MERGES = """
create table merges as
select l.id * 65536 + r.id as pair, t.id as merged
from (select id, token, unnest(range(1, octet_length(token))) as cut from vocabulary) t
join vocabulary l on l.token = t.token[1:t.cut] join vocabulary r on r.token = t.token[t.cut + 1:]
"""

#: A row a token: its bytes [spot, stop) in its word, its id, that of the token after it, and what the two merge to. Each
#: round contracts one pair of each word: the left token goes, the right one takes its place, and the token before sees it.
_ENCODE = """
create or replace temp table state as
with recursive tokens(word, spot, stop, id, after, merged, round) as (
    select word, spot, stop, id, after, m.merged, 0
    from begun left join merges m on m.pair = id * 65536 + after
    union all
    select x.word, x.spot, x.stop, x.id, x.after, m.merged, x.round
    from (
        select t.word, t.stop, t.round + 1 as round, case when t.spot = b.mid then b.first & 4294967295 else t.spot end as spot,
               case when t.spot = b.mid then b.first >> 32 else t.id end as id,
               case when t.stop = b.first & 4294967295 then b.first >> 32 else t.after end as after
        from tokens t
        join (
            select word, min((merged << 32) + spot) as first, arg_min(stop, (merged << 32) + spot) as mid
            from tokens where merged is not null group by word
        ) b on b.word = t.word and t.spot <> b.first & 4294967295
    ) x left join merges m on m.pair = x.id * 65536 + x.after
),
ended as (select word, max(round) as round from tokens group by word)
select t.word, t.spot, t.stop, t.id from tokens t join ended using (word, round)
"""

#: The same for long words, whose rounds would take too much memory: rows are replaced by key, and the state is stored after
#: some rounds. A round contracts all places of a word's smallest rank, in `chain`s of overlapping ones every other place;
#: `once` keeps it to the leftmost place. Contracted right-hand tokens stay as rows without an id.
_ENCODE_LONG = """
create or replace temp table state as
with recursive tokens(word, spot, stop, id, after, merged, round) using key (word, spot) as (
    select word, spot, stop, id, after, m.merged, 0
    from begun left join merges m on m.pair = id * 65536 + after
    union all (
        with least as (
            select word, min(merged) as merged from recurring.tokens
            where (select max(round) from tokens) < {rounds} group by word having min(merged) is not null
        ),
        places as (
            select t.word, t.spot, t.stop as mid, t.merged, lag(t.stop) over (partition by t.word order by t.spot) is distinct from t.spot as apart
            from recurring.tokens t join least l on l.word = t.word and l.merged = t.merged
        ),
        chains as (select *, sum(apart::int) over (partition by word order by spot) as chain from places),
        chosen as (
            select word, spot, mid, merged
            from (select *, row_number() over (partition by word, chain order by spot) as nth from chains) where nth % 2 = 1 {once}
        ),
        changed as (
            select c.word, c.spot, r.stop, c.merged as id, coalesce(n.merged, r.after) as after
            from chosen c join recurring.tokens r on r.word = c.word and r.spot = c.mid left join chosen n on n.word = c.word and n.spot = r.stop
            union all
            select word, mid, null, null, null from chosen
            union all
            select c.word, p.spot, p.stop, p.id, c.merged
            from chosen c join recurring.tokens p on p.word = c.word and p.stop = c.spot left join chosen d on d.word = c.word and d.mid = p.spot
            where d.word is null
        )
        select x.word, x.spot, x.stop, x.id, x.after, m.merged, (select max(round) + 1 from tokens)
        from changed x left join merges m on m.pair = x.id * 65536 + x.after
    )
)
select word, spot, stop, id, after, merged from tokens where id is not null
"""
_ONCE = "qualify row_number() over (partition by word order by spot) = 1"

_DECODE = """
select word, string_agg(cast(id as varchar), ',') as ids, string_agg(hex(token), '') as bytes
from (select s.word, s.id, v.token from state s join vocabulary v using (id) order by s.word, s.spot) group by word
"""


class Coder:
    """ids, raw: stretch of text -> its ids as ASCII joined by commas, and the bytes that these ids decode to."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        self.ids: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}
        self._held, self._one_way = 0, None
        self._split = regex.compile(pattern)
        with open(path, "rb") as f:
            self._ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._byte = np.array([self._ranks[bytes([b])] for b in range(256)])
        self._db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        vocabulary = pd.DataFrame({"token": list(self._ranks), "id": list(self._ranks.values())})  # noqa: F841  read by name
        self._db.execute("create table vocabulary as select cast(token as blob) as token, cast(id as bigint) as id from vocabulary")
        self._db.execute(_MERGES)

    def _begin(self, raws: list[bytes], whole: bool = True) -> int:
        """Fills the table `begun` with the first tokens of words, which are bytes, or the word itself if it is a token."""
        known = [(i, 0, len(r), self._ranks[r]) for i, r in enumerate(raws) if r in self._ranks] if whole else []
        done = {i for i, *_ in known}
        rest = [i for i in range(len(raws)) if i not in done]
        n = np.array([len(raws[i]) for i in rest], np.int64)
        spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.array([(*k, -1) for k in known], np.int64).reshape(-1, 5)
        ids = self._byte[np.frombuffer(b"".join([raws[i] for i in rest]), np.uint8)]
        after = np.append(ids, -1)[1:]
        after[np.cumsum(n)[n > 0] - 1] = -1
        last = np.column_stack([np.repeat(np.array(rest, np.int64), n), spot, spot + 1, ids, after])
        frame = pd.DataFrame(np.concatenate([first, last]), columns=["word", "spot", "stop", "id", "after"])  # noqa: F841  read by name
        self._db.execute("create or replace temp table begun as select * from frame")
        return len(last)

    def _monotone(self) -> bool:
        """Whether every token comes out of merging its own bytes. Then merges never give a smaller rank than the one at
        hand, so that all places of a word's smallest rank may be contracted in one round."""
        if self._one_way is None:
            tokens, self._one_way = list(self._ranks), True
            for at in range(0, len(tokens), _WORDS):
                part = [t for t in tokens[at : at + _WORDS] if len(t) <= _SHORT]
                self._begin(part, whole=False)
                self._db.execute(_ENCODE)
                self._one_way &= len(part) == self._db.execute("select count(*) from state").fetchone()[0]
            self._one_way &= max(map(len, tokens)) <= _SHORT
        return self._one_way

    def _long(self, raws: list[bytes]) -> None:
        once = "" if self._monotone() else _ONCE
        rows = self._begin(raws)
        self._db.execute(f"set memory_limit = '{250 + rows // 2000}MB'")
        while True:
            self._db.execute(_ENCODE_LONG.format(rounds=max(1, _STEPS // max(1, rows)), once=once))
            rows, open_ = self._db.execute("select count(*), count(merged) from state").fetchone()
            if not open_:
                break
            self._db.execute("create or replace temp table begun as select word, spot, stop, id, after from state")
        self._db.execute("set memory_limit = '250MB'")

    def _learn(self, words: list[str]) -> None:
        """Encodes words and decodes their ids."""
        for part, long in self._dealt(words):
            raws = [w.encode() for w in part]
            if long:
                self._long(raws)
            else:
                self._begin(raws)
                self._db.execute(_ENCODE)
            found = self._db.execute(_DECODE).fetchnumpy()
            for word, ids, raw in zip(found["word"].tolist(), found["ids"], found["bytes"], strict=True):
                self._keep(part[word], ids.encode(), bytes.fromhex(raw))

    @staticmethod
    def _dealt(words: list[str]) -> Iterator[tuple[list[str], bool]]:
        short = [w for w in words if len(w) <= _SHORT // 4 or len(w.encode()) <= _SHORT]
        for at in range(0, len(short), _WORDS):
            yield short[at : at + _WORDS], False
        if len(short) < len(words):
            part, size = [], 0
            for w in set(words).difference(short):
                if part and size + len(w.encode()) > _LONG_BYTES:
                    yield part, True
                    part, size = [], 0
                part.append(w)
                size += len(w.encode())
            yield part, True

    def _keep(self, text: str, ids: bytes, raw: bytes) -> None:
        self.ids[text], self.raw[text] = ids, raw
        self._held += 260 + 2 * len(raw) + len(ids)

    def meet(self, stretches: Iterable[str]) -> None:
        """Makes sure that all the stretches are known."""
        if self._held > _HELD:
            self.ids.clear()
            self.raw.clear()
            self._held = 0
        new = set(stretches).difference(self.ids)
        cut = {s: self._split.findall(s) for s in new if not (s.isascii() and s.removeprefix(" ").isalpha())}
        self._learn(list(new.difference(cut).union(chain.from_iterable(cut.values())).difference(self.ids)))
        for s, words in cut.items():
            if len(words) > 1:
                self._keep(s, b",".join(map(self.ids.__getitem__, words)), b"".join(map(self.raw.__getitem__, words)))

    def forget(self, stretches: Iterable[str]) -> None:
        """Drops long stretches and words, which are not met again as a rule."""
        for s in {s for s in stretches if len(s) > _BRIEF}:
            for w in (s, *self._split.findall(s)):
                if len(w) > _BRIEF and w in self.ids:
                    self._held -= 260 + 2 * len(self.raw.pop(w)) + len(self.ids.pop(w))

    def stretches(self, text: str) -> list[str]:
        """Cuts before single spaces between visible characters, where the pattern must begin a match; else by pattern."""
        if not text or "\0" in text or _loose(text):
            return self._split.findall(text)
        return text.replace(" ", "\0 ").split("\0")


def _loose(text: str) -> bool:
    raw = text.encode()
    if not text.isascii() and any(w in raw for w in _WIDE):
        return bool(_LOOSE.search(text))
    flat = raw.translate(_FLAT)
    return b"  " in flat or flat[:1] == b" " or flat[-1:] == b" "


def _parts(text: str | None) -> list[str]:
    """A text, in parts that the pattern cuts alike, of about _PART characters where it has a joint."""
    text = text if isinstance(text, str) else ""
    out, at = [], 0
    while len(text) - at > 2 * _PART and (joint := _JOINT.search(text, at + _PART)):
        out.append(text[at : joint.start()])
        at = joint.start()
    return [*out, text[at:]]


_loaded: dict[tuple[str, str], Coder] = {}


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    Null and empty texts have no ids. Words that are a token as a whole are that token, like in the public library; all
    others are merged by rank. Null ids and repeated rows stand alone. Other columns are not looked at; an empty table
    gives no rows. Memory is bounded whatever the texts, but for the longest word: a text without white space is one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = Coder(path, pattern)
        coder = _loaded[path, pattern]
        for pdf in batches:
            parts = [(row, part) for row, text in enumerate(pdf["text"]) for part in _parts(text)]
            n = [0] * len(pdf)
            ids, raw = [hashlib.sha256() for _ in n], [hashlib.sha256() for _ in n]
            at = 0
            while at < len(parts):
                size, group = 0, []
                while at < len(parts) and size < _BATCH:
                    row, text = parts[at]
                    group.append((row, coder.stretches(text)))
                    size += len(text)
                    at += 1
                coder.meet(chain.from_iterable(s for _, s in group))
                for row, stretches in group:
                    if stretches:
                        own = b",".join(map(coder.ids.__getitem__, stretches))
                        ids[row].update(b"," + own if n[row] else own)
                        n[row] += own.count(b",") + 1
                        raw[row].update(b"".join(map(coder.raw.__getitem__, stretches)))
                coder.forget(chain.from_iterable(s for _, s in group))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n, "ids_sha256": [h.hexdigest() for h in ids], "decoded_sha256": [h.hexdigest() for h in raw]})

    rows = docs.select(exact(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return numbered(spread(rows).mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"))
