"""Byte-level BPE by recursive DuckDB queries, one small database a Python worker.

A text is cut into words by the tokenizer's pattern; a word that isn't a token
itself becomes rows (word, position, token), first one a byte. Each step of the
recursive query joins neighbouring rows to the merge table, takes every word's
leftmost pair of least rank, and contracts it; words without a pair drop out. What
a query holds is bounded: words are grouped by the states that they can make, and a
long word goes through several queries, whose steps contract many places at once.
A word seen before in the worker is looked up, in a cache of bounded size that is
emptied when full; the result doesn't depend on it. Decoding meets all ids of each
text with the vocabulary and puts the bytes together by an ordered aggregation.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: Words of a query, and words and pieces kept between texts.
QUERY_WORDS, KEPT_WORDS, KEPT_PIECES = 100_000, 800_000, 500_000
#: Bytes from which a word is long, and states that the steps of one recursive query may make.
LONG_BYTES, QUERY_STATES = 400, 4_000_000
#: Ids that one query decodes.
QUERY_IDS = 500_000
_DOUBLE_SPACE = re.compile(r"\s\s")
#: A single space between two signs begins a match of the pattern, whatever stands around it.
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")

#: Every state that a word passes through; the last step of each word is its coding.
ENCODE = """
create or replace temp table coded as
with recursive state as (
  select w, pos, tok, 0 as step,
         lead(tok) over place as next_tok, lead(pos) over place as next_pos
  from bytes_in window place as (partition by w order by pos)
  union all
  (with pairs as (
     select s.w, s.next_pos, m.merged::bigint * 1048576 + s.pos as ranked
     from state s join merges m on m.pair = s.tok::bigint * 1048576 + s.next_tok),
   best as (select w, min(ranked) as ranked, arg_min(next_pos, ranked) as gone from pairs group by w),
   cut as (
     select b.w, b.ranked % 1048576 as at, (b.ranked // 1048576)::integer as merged, b.gone,
            s.next_tok as after_tok, s.next_pos as after_pos
     from best b join state s on s.w = b.w and s.pos = b.gone)
   select s.w, s.pos, case when s.pos = c.at then c.merged else s.tok end, s.step + 1,
          case when s.pos = c.at then c.after_tok when s.next_pos = c.at then c.merged else s.next_tok end,
          case when s.pos = c.at then c.after_pos else s.next_pos end
   from state s join cut c on s.w = c.w where s.pos <> c.gone)
)
select w, pos, tok, step from state
"""
CODED = """
select c.w, c.tok from coded c
join (select w, max(step) as step from coded group by w) last on c.w = last.w and c.step = last.step
order by c.w, c.pos
"""
#: A long word's step contracts at once what single steps would: its pair of least rank, from
#: left to right, up to the first place where the new token makes a pair of a lesser rank.
#: It stops after a number of steps, and goes on from there in another query.
ENCODE_LONG = """
create or replace temp table coded as
with recursive state as (
  select w, pos, tok, 0 as step from bytes_in
  union all
  (with placed as (
     select *, row_number() over x as i, lag(tok) over x as before, lead(tok) over x as after, lead(tok, 2) over x as then_tok
     from state where step < {steps} window x as (partition by w order by pos)),
   pairs as (select p.*, m.merged from placed p join merges m on m.pair = p.tok::bigint * 1048576 + p.after),
   least as (select w, min(merged) as merged from pairs group by w),
   hits as (
     select p.*, i - row_number() over (partition by w order by i) as run
     from pairs p join least using (w, merged)),
   apart as (select * from hits qualify row_number() over (partition by w, run order by i) % 2 = 1),
   sides as (select *, case when lag(i) over (partition by w order by i) = i - 2 then merged else before end as left_tok from apart),
   lesser as (
     select s.w, min(s.i) as i from sides s
     left join merges a on a.pair = s.left_tok::bigint * 1048576 + s.merged
     left join merges b on b.pair = s.merged::bigint * 1048576 + s.then_tok
     where a.merged < s.merged or b.merged < s.merged group by s.w),
   cut as (select s.w, s.i, s.merged from sides s left join lesser l on l.w = s.w where l.i is null or s.i <= l.i)
   select p.w, p.pos, coalesce(c.merged, p.tok), p.step + 1
   from placed p join least using (w) left join cut c on c.w = p.w and c.i = p.i left join cut g on g.w = p.w and g.i = p.i - 1
   where g.i is null)
)
select w, pos, tok, step from state
"""
LAST = "select c.w, c.pos, c.tok, c.step from coded c join (select w, max(step) as step from coded group by w) last on c.w = last.w and c.step = last.step order by c.w, c.pos"
#: A byte is written as the character of that number, so the text's Latin-1 bytes are the result.
#: Ids are put in order first, and looked up in the vocabulary as one list.
DECODE = """
select i.r, array_to_string(list_transform(i.toks, lambda t: v.pieces[t + 1]), '') as piece
from (select r, list(tok order by pos) as toks from ids_in group by r) i, vocabulary v order by i.r
"""


def read_ranks(path: str) -> bytes:
    """The rank file as it is: one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return f.read()


class Codec:
    def __init__(self, rank_file: bytes, pattern: str):
        import duckdb

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.pattern = regex.compile(pattern)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        pairs = pa.table({"pair": np.array(left, np.int64) * 1048576 + np.array(right, np.int64), "merged": np.array(merged, np.int32)})
        names = pa.table({"tok": pa.array(self.ranks.values(), pa.int32()), "piece": [k.decode("latin-1") for k in self.ranks]})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self.db.register("pairs_in", pairs)
        self.db.register("names_in", names)
        self.db.execute("create table merges as select * from pairs_in")
        self.db.execute("create table vocabulary as select list(piece order by n.tok) as pieces from range((select max(tok) + 1 from names_in)) n(tok) left join names_in using (tok)")
        self.db.unregister("pairs_in"), self.db.unregister("names_in")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.decimal = np.array([str(i) for i in range(max(self.ranks.values()) + 1)], dtype=object)
        self.words: dict[str, str] = {}
        self.pieces: dict[str, str] = {}

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has (words are matches of the pattern; none is empty)."""
        rank = np.fromiter((self.ranks.get(w, -1) for w in words), np.int32, len(words))
        counts = np.ones(len(words), dtype=np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        todo = np.flatnonzero((rank < 0) & (size <= LONG_BYTES))
        found: dict[int, np.ndarray] = {}
        for k in np.flatnonzero((rank < 0) & (size > LONG_BYTES)).tolist():
            found[k] = self._encode_long(words[k])
            counts[k] = len(found[k])
        # a word of n bytes goes through at most n states of at most n rows
        states = np.cumsum(size[todo] * (size[todo] + 1) // 2)
        begin = 0
        while begin < len(todo):
            before = states[begin - 1] if begin else 0
            end = min(begin + QUERY_WORDS, max(begin + 1, int(np.searchsorted(states, before + QUERY_STATES, side="right"))))
            part = todo[begin:end]
            self._put("bytes_in", np.repeat(np.arange(len(part), dtype=np.int32), size[part]), b"".join([words[i] for i in part]), size[part])
            self.db.execute(ENCODE)
            self.db.unregister("bytes_in")
            got = self.db.execute(CODED).fetchnumpy()
            own = np.bincount(got["w"], minlength=len(part))
            counts[part] = own
            tok = np.asarray(got["tok"], np.int32)
            for i, ids in zip(part.tolist(), np.split(tok, np.cumsum(own)[:-1]), strict=True):
                found[i] = ids
            begin = end
        flat = np.empty(int(counts.sum()), np.int32)
        direct = np.repeat(rank >= 0, counts)
        flat[direct] = rank[rank >= 0]
        flat[~direct] = np.concatenate([found[i] for i in np.flatnonzero(rank < 0).tolist()]) if found else 0
        return flat, counts

    def _put(self, name: str, w: np.ndarray, data: bytes, size: np.ndarray) -> None:
        """Register the bytes of words as rows of first tokens."""
        pos = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
        self.db.register(name, pa.table({"w": w, "pos": pos.astype(np.int32), "tok": self.byte[np.frombuffer(data, np.uint8)]}))

    def _encode_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word, by recursive queries of a bounded number of states each."""
        self._put("bytes_in", np.zeros(len(word), np.int32), word, np.array([len(word)]))
        left = len(word)
        while True:
            steps = max(1, QUERY_STATES // left)
            self.db.execute(ENCODE_LONG.format(steps=steps))
            self.db.unregister("bytes_in")
            got = self.db.execute(LAST).fetchnumpy()
            if got["step"][0] < steps:
                return np.asarray(got["tok"], np.int32)
            left = len(got["tok"])
            self.db.register("bytes_in", pa.table({k: np.asarray(got[k], np.int32) for k in ("w", "pos", "tok")}))

    def decode_runs(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids; ``flat`` holds the runs one after the other. A long run goes through several queries."""
        run = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
        out: list[list[bytes]] = [[] for _ in counts]
        for k in range(0, len(flat), QUERY_IDS):
            own = run[k : k + QUERY_IDS]
            self.db.register("ids_in", pa.table({"r": own, "pos": np.arange(len(own), dtype=np.int32), "tok": flat[k : k + QUERY_IDS]}))
            got = self.db.execute(DECODE).fetchnumpy()
            self.db.unregister("ids_in")
            for i, text in zip(got["r"].tolist(), got["piece"], strict=True):
                out[i].append(text.encode("latin-1"))
        return [b"".join(parts) for parts in out]

    def _learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if not new:
            return
        if len(self.words) + len(new) > KEPT_WORDS:
            self.words.clear()
            new = list(dict.fromkeys(words))
        flat, counts = self.encode_words([w.encode() for w in new])
        names, at = self.decimal[flat].tolist(), 0
        for w, n in zip(new, counts.tolist(), strict=True):
            self.words[w] = names[at] if n == 1 else " ".join(names[at : at + n])
            at += n

    def codes(self, texts: list[str | None]) -> list[str]:
        """The decimal ids of each whole text, joined by one space.

        A text is cut at single spaces, which the pattern never matches across: its first part, and parts that each
        follow a space. Parts are looked up; for new ones, their words are.
        """
        cut = [(_LONE_SPACE.split(t) if _DOUBLE_SPACE.search(t) or t[-1] == " " or t[0] == " " else t.split(" ")) if t else [""] for t in texts]
        heads = [c.pop(0) for c in cut]
        every = set().union(*cut)
        new = list(every.difference(self.pieces))
        if len(self.pieces) + len(new) > KEPT_PIECES:
            self.pieces.clear()
            new = list(every)
        for k in range(0, len(new), QUERY_WORDS):
            part = new[k : k + QUERY_WORDS]
            for p, code in zip(part, self._coded([" " + p for p in part]), strict=True):
                self.pieces[p] = code
        first, get = self._coded(heads), self.pieces.__getitem__
        return [" ".join([h, *map(get, c)] if h else map(get, c)) for h, c in zip(first, cut, strict=True)]

    def _coded(self, parts: list[str]) -> list[str]:
        """The ids of each part by itself."""
        own = [self.pattern.findall(p) for p in parts]
        self._learn(list(chain.from_iterable(own)))
        get = self.words.__getitem__
        return [get(o[0]) if len(o) == 1 else " ".join(map(get, o)) for o in own]

    def ids(self, codes: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all codes one after the other, and how many each has."""
        flat = np.fromstring(" ".join(filter(None, codes)), dtype=np.int32, sep=" ") if any(codes) else np.zeros(0, np.int32)
        return flat, np.array([c.count(" ") + 1 if c else 0 for c in codes], dtype=np.int64)


_codecs: dict[str, Codec] = {}


def _codec(rank_file: bytes, pattern: str) -> Codec:
    name = hashlib.md5(rank_file + pattern.encode()).hexdigest()
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(rank_file, pattern)
    return _codecs[name]


def _groups(texts: list, limit: int = 2 << 20) -> list[slice]:
    """Slices of about ``limit`` characters, so that what a query holds is bounded."""
    out, begin, have = [], 0, 0
    for i, t in enumerate(texts):
        have += len(t or "")
        if have >= limit:
            out.append(slice(begin, i + 1))
            begin, have = i + 1, 0
    return [*out, slice(begin, len(texts))]


def encode(docs: DataFrame, rank_file: bytes, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (array of int), the ids of the whole text; a null or empty text has none."""
    sent = docs.sparkSession.sparkContext.broadcast(rank_file)

    def start():
        codec = _codec(sent.value, pattern)

        def each(batch: list) -> list[pa.Array]:
            out = []
            for g in _groups(batch):
                flat, counts = codec.ids(codec.codes(batch[g]))
                out += np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []
            return [pa.array(out, pa.list_(pa.int32()))]

        return each

    return common.map_text(docs, start, {"ids": "array<int>"}, keep)


def decode(coded: DataFrame, rank_file: bytes, pattern: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded`` (binary): the bytes of the ids, in order. A null list has none; an unknown id fails."""
    sent = coded.sparkSession.sparkContext.broadcast(rank_file)

    def start():
        codec = _codec(sent.value, pattern)
        known = set(codec.ranks.values())

        def each(batch: list) -> list[pa.Array]:
            if unknown := {i for r in batch for i in r or ()} - known:
                raise ValueError(f"ids that the vocabulary lacks: {sorted(unknown, key=str)[:5]}")
            counts = np.fromiter((len(r or ()) for r in batch), np.int64, len(batch))
            flat = np.fromiter(chain.from_iterable(r or () for r in batch), np.int32, int(counts.sum()))
            return [pa.array(codec.decode_runs(flat, counts), pa.binary())]

        return each

    return common.map_text(coded, start, {"decoded": "binary"}, keep, text=ids)


def round_trip(docs: DataFrame, rank_file: bytes, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Encode each whole text and decode the ids again: their number and the two digests.

    ``ids_sha256`` is of the decimal ids joined by one space, ``decoded_sha256`` of
    the bytes that the ids decode to. A null text counts as empty: no ids, and
    the digests of nothing. Repeated rows each get their row; columns named like
    the added ones are replaced. Texts of any length are coded whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(rank_file)

    def start():
        codec = _codec(sent.value, pattern)

        def each(batch: list) -> list[pa.Array]:
            n, coded, decoded = [], [], []
            for g in _groups(batch):
                codes = codec.codes(batch[g])
                flat, counts = codec.ids(codes)
                n += counts.tolist()
                coded += [hashlib.sha256(c.encode()).hexdigest() for c in codes]
                decoded += [hashlib.sha256(d).hexdigest() for d in codec.decode_runs(flat, counts)]
            return [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]

        return each

    return common.map_text(docs, start, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, keep)
