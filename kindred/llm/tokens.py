"""Token-ID files: tokenised documents in doc_id order, compressed with a Re-Pair grammar per shard.

`write_ids` deals documents to ranges of doc_id, tokenises each range in order, appends the end id to
each document and packs runs of documents into shards of up to `SHARD_IDS` ids; a longer document goes
on over several shards. A shard's ids are replaced by a grammar: in each round the most frequent pairs of
neighbouring symbols, those that stand `LEAST_COUNT` times or more, become nonterminals, all at once, and
the next round counts pairs of the shorter sequence. Rounds go on until there is no such pair or all 65,536
symbols are used. No rule starts with the end id, so documents begin and end between symbols. A shard
stores its rules, the length every rule expands to, its symbols, and each document's symbol and id counts:
enough to decode any document, or any range of ids, without the rest (`decode_document`, `decode_range`).

Shards are rows of a Parquet dataset: a driver and executors need no other shared place, a lost task
is written again, and a partial write is never read.

Tokens are those of the tokenizers library. Texts are cut into words in Arrow, and its BPE model gets each
new word once, many at a time. Up to `cache_words` words are kept with their ids; when there are more, the
half that was used last stays. A text goes to the library as a whole if it holds code points or special tokens for which cutting it here might
differ from the library's own cut.

Memory: a text, its ids (two bytes each), slices of 8 million code points cut into words, and one
shard's Re-Pair; what is cut and packed does not grow with the text. Texts for the library alone are held
with its own encoding of them.

Nulls: a null text is empty (its ids are the end id alone); rows with a null doc_id come first. Rows
with equal doc_id are ordered by a hash of their text, equal rows follow each other. An empty table gives
no shards and no rows. Only doc_id (as a long) and text are read; other columns, whatever their names,
are left alone.
"""

from __future__ import annotations

import functools
import json
import operator
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

SHARD_IDS = 1 << 18
LEAST_COUNT = 8
MAGIC = b"RPG2"
CACHE_WORDS = 800_000
SLICE = 1 << 23
SHORT = 64
#: Fixed value: the byte-level BPE's pattern, as in the public tokenizer's description.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Its letters and numbers among the code points below 256; these texts are cut here, others by the library.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
#: Code points below 256 that the pattern and the library may see differently; the other blanks.
DOUBTFUL, BLANKS = bytes([28, 29, 30, 31, 0x85, 0xA0]), bytes.maketrans(b"\t\x0b\x0c\r", b"\n\n\n\n")
LONE_SPACE = re.compile(r"(?<!\s) (?!\s)")
#: Between pieces on their way to the model; no text that is cut here has it.
DELIMITER = "\u2000"


def _alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts, below 65,536, by a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.cache_words = CACHE_WORDS
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        if size > 65536:
            raise ValueError("ids must be below 65,536")
        with open(path) as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.by_word = bool(plain and spec["normalizer"] is None and spec["model"]["type"] == "BPE")
        # The library's model over pieces that are cut and spelled in the byte-level alphabet already.
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.table = _alphabet()
        self.mark = DELIMITER.encode().decode("latin-1").translate(self.table)
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.pattern = re.compile(PATTERN.replace(r"^\s\p{L}\p{N}", f"^\\s{LETTERS}{NUMBERS}").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]"))
        # Words met behind a space, where their ids stand in flat, and the last turn that used them.
        self.known = pa.array([], pa.string())
        self.flat = np.zeros(0, np.uint16)
        self.start, self.size, self.used, self.turn = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    def _pieces(self, pieces: list[str]) -> np.ndarray:
        """Ids of pieces of the pattern, all at once."""
        spelled = DELIMITER.join(pieces).encode().decode("latin-1").translate(self.table).replace(self.mark, " ")
        return np.array(self.pieces.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, dtype=np.uint16)

    def _ends(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the ids of each of some strings end, from the strings' sizes in bytes."""
        return np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes), side="right").astype(np.int32)

    def _learn(self, words: pa.Array) -> None:
        """Tokenise new words at once: each behind a space, so that no piece belongs to two of them."""
        ids = self._pieces(self.pattern.findall(" " + " ".join(words.to_pylist())))
        ends = self._ends(ids, pc.binary_length(words).to_numpy() + 1)
        size = np.diff(ends, prepend=np.int32(0))
        self.start = np.concatenate([self.start, np.int32(len(self.flat)) + ends - size])
        self.size = np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int32)])
        self.flat = np.concatenate([self.flat, ids])
        self.known = pa.concat_arrays([self.known, words])

    def _forget(self) -> None:
        """Keep the words used last, half as many as may be held."""
        self.turn += 1
        if len(self.known) > self.cache_words:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: self.cache_words // 2])
            self.flat = _gather(self.flat, self.start[keep], self.size[keep])
            self.known, self.size, self.used = self.known.take(pa.array(keep)), self.size[keep], self.used[keep]
            self.start = np.cumsum(self.size, dtype=np.int32) - self.size

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are cut at spaces; only words that are not known go to the model."""
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        offsets, coded = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        number, kinds = coded.indices.to_numpy(), coded.dictionary
        found = pc.index_in(kinds, value_set=self.known)
        place = found.fill_null(-1).to_numpy().copy()
        if found.null_count:
            place[place < 0] = np.arange(len(self.known), len(self.known) + found.null_count)
            self._learn(kinds.filter(found.is_null()))
        self.used[place] = self.turn
        start, size = self.start[place][number], self.size[place][number]
        # A text's first word has no space in front.
        first = lists.values.take(pa.array(offsets[:-1])).to_pylist()
        ids = self._pieces([p for word in first for p in self.pattern.findall(word)])
        ends = self._ends(ids, np.array([len(word.encode()) for word in first]))
        size[offsets[:-1]] = np.diff(ends, prepend=np.int32(0))
        start[offsets[:-1]] = len(self.flat) + ends - size[offsets[:-1]]
        flat = np.concatenate([self.flat, ids])
        self._forget()
        return [_gather(flat, start[a:z], size[a:z]) for a, z in zip(offsets, offsets[1:])]  # noqa: B905  one offset more

    def _way(self, text: str) -> str:
        """How a text can be cut: at spaces, by the pattern, or by the library alone."""
        if not self.by_word or any(s in text for s in self.special):
            return "library"
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return "library"
        if len(raw.translate(None, DOUBTFUL)) < len(raw):
            return "library"
        # Blanks next to each other: a space among them joins no word.
        blank = raw.translate(BLANKS)
        return "pattern" if any(pair in blank for pair in (b"  ", b" \n", b"\n ")) else "spaces"

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of some texts; longer ones are cut into words a slice at a time."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        parts, owner = [], []
        for i, text in enumerate(texts):
            way = self._way(text)
            if way == "library":
                out[i].append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint16))
                continue
            at = 0
            while at < len(text):
                # Up to the next lone space behind the slice; the next slice starts with it.
                lone = LONE_SPACE.search(text, at + SLICE) if len(text) > at + SLICE else None
                end = lone.start() if lone else len(text)
                if way == "pattern":
                    out[i].append(self._pieces(self.pattern.findall(text[at:end])))
                elif len(text) > SLICE:
                    out[i] += self._by_words([text[at:end]])
                else:
                    parts.append(text)
                    owner.append(i)
                at = end
        for i, ids in zip(owner, self._by_words(parts) if parts else [], strict=True):
            out[i].append(ids)
        return [ids[0] if len(ids) == 1 else np.concatenate([np.zeros(0, np.uint16), *ids]) for ids in out]


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of flat at start, one after the other."""
    ends = np.cumsum(size)
    return flat.take(np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size))


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """The process's encoder for a file; a worker that runs more tasks keeps the words it knows."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].cache_words = cache_words
    return _ENCODERS[path]


def _slots(code: np.ndarray) -> np.ndarray:
    return (code * np.uint32(2654435761)) >> np.uint32(12)


def repair(ids: np.ndarray, vocabulary: int, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rules (rows of two symbols; rule r stands for symbol vocabulary + r) and the symbols left."""
    wide = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    base = fresh = vocabulary
    near = np.arange(len(wide) - 1)
    table = np.zeros(1 << 20, dtype=np.uint16)
    ending = np.array([end_id, end_id + 1], dtype=np.uint32) << np.uint32(16)
    while len(near) >= LEAST_COUNT and base < 65536:
        code = (wide.take(near) << np.uint32(16)) | wide.take(near + 1)
        ordered = np.sort(code)
        # A pair that stands LEAST_COUNT times is equal to what stands so many places on.
        frequent = ordered.take(np.flatnonzero(ordered[LEAST_COUNT - 1 :] == ordered[: 1 - LEAST_COUNT]))
        frequent = frequent[np.flatnonzero(np.diff(frequent, prepend=~frequent[:1]))]
        a, z = np.searchsorted(frequent, ending)
        frequent = np.concatenate([frequent[:a], frequent[z:]])
        if not len(frequent):
            break
        count = np.searchsorted(ordered, frequent, "right") - np.searchsorted(ordered, frequent)
        pairs = frequent[np.argsort(-count, kind="stable")[: 65536 - base]]
        # Pairs by a hash of 20 bits; of two in one place the rarer waits for the next round.
        slot = _slots(pairs)
        _, own = np.unique(slot, return_index=True)
        own.sort()
        waiting = len(own) < len(frequent)
        pairs, slot = pairs[own], slot[own]
        table[slot] = np.arange(1, len(pairs) + 1)
        rule = table.take(_slots(code))
        table[slot] = 0
        found = np.flatnonzero(rule)
        rule = rule.take(found).astype(np.int64) - 1
        same = pairs.take(rule) == code.take(found)
        place, rule = near.take(np.compress(same, found)), np.compress(same, rule)
        # Of overlapping places every other one is replaced, from the left.
        new = np.diff(place, prepend=-2) != 1
        run = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
        take = (np.arange(len(place)) - run) % 2 == 0
        place, rule = np.compress(take, place), np.compress(take, rule)
        # Pairs that overlaps have left without a place are no rules.
        used = np.bincount(rule, minlength=len(pairs)) > 0
        pairs, number = pairs[used], np.cumsum(used) - 1
        wide[place] = base + number.take(rule)
        keep = np.ones(len(wide), bool)
        keep[place + 1] = False
        wide = np.compress(keep, wide)
        rules.append(np.stack([pairs >> np.uint32(16), pairs & np.uint32(0xFFFF)], 1))
        # A place that is not replaced has lost a symbol, so only pairs with a new symbol can be frequent now.
        fresh, base = vocabulary if waiting else base, base + len(pairs)
        is_new = wide >= fresh
        near = np.arange(len(wide) - 1) if waiting else np.flatnonzero(is_new[:-1] | is_new[1:])
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), wide


def pack(ids: np.ndarray, lengths: np.ndarray, vocabulary: int, end_id: int = 0) -> bytes:
    """A shard: magic, counts, rules, expansion lengths, symbols, and per document ids and symbols."""
    rules, symbols = repair(ids, vocabulary, end_id)
    length = np.ones(vocabulary + len(rules), dtype=np.int64)
    for r, (a, b) in enumerate(rules.tolist()):
        length[vocabulary + r] = length[a] + length[b]
    ends = np.cumsum(length[symbols])
    last = np.searchsorted(ends, np.cumsum(lengths)) + 1 if len(symbols) else np.zeros(0, np.int64)
    head = np.array([vocabulary, len(rules), len(symbols), len(lengths)], dtype="<u4").tobytes()
    body = [rules.astype("<u2"), length[vocabulary:].astype("<u4"), symbols.astype("<u2"), np.asarray(lengths).astype("<u4"), np.diff(last, prepend=0).astype("<u4")]
    return MAGIC + head + b"".join(x.tobytes() for x in body)


class Shard:
    """A packed shard, open for reading."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard")
        self.vocabulary, rules, symbols, docs = np.frombuffer(blob, "<u4", 4, 4).tolist()
        at = 20

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u2", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.sizes, self.symbols = take("<u4", rules), take("<u2", symbols)
        self.lengths, self.symbol_counts = take("<u4", docs), take("<u4", docs)
        if at != len(blob):
            raise ValueError("the shard's size is wrong")
        self.size = np.concatenate([np.ones(self.vocabulary, np.int64), self.sizes.astype(np.int64)])
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def _halved(self, symbols: np.ndarray, most: int) -> np.ndarray:
        """Symbols with those that stand for more than `most` ids replaced by their halves, as often as need be."""
        while (long := self.size[symbols] > most).any():
            place = np.cumsum(long + 1) - long - 1
            wider = np.empty(len(symbols) + int(long.sum()), np.int64)
            wider[place[~long]] = symbols[~long]
            halves, at = self.rules[symbols[long] - self.vocabulary], place[long]
            wider[at], wider[at + 1] = halves[:, 0], halves[:, 1]
            symbols = wider
        return symbols

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of symbols: long rules are halved until they are short, short ones are looked up."""
        if self._table is None:
            held = np.where(self.size <= SHORT, self.size, 0)
            short = np.flatnonzero(self.sizes <= SHORT) + self.vocabulary
            flat = np.concatenate([np.arange(self.vocabulary), self._halved(short, 1)]).astype(np.uint32)
            self._table = np.cumsum(held) - held, flat
        first, flat = self._table
        symbols = self._halved(symbols.astype(np.int64), SHORT)
        return _gather(flat, first[symbols], self.size[symbols])

    def decode(self) -> np.ndarray:
        return self._expand(self.symbols)

    def decode_document(self, i: int) -> np.ndarray:
        a = int(self.symbol_counts[:i].sum())
        return self._expand(self.symbols[a : a + int(self.symbol_counts[i])])

    def decode_range(self, start: int, count: int) -> np.ndarray:
        """ids start .. start + count, expanding only the symbols that cover them."""
        ends = np.cumsum(self.size[self.symbols])
        a, z = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, start + count)
        before = int(ends[a - 1]) if a else 0
        return self._expand(self.symbols[a : z + 1])[start - before : start - before + count]


def _encoded(encoder: Encoder, batch: pa.RecordBatch, most: int = SLICE) -> Iterator[tuple[int | None, np.ndarray]]:
    """Keys and ids of a batch's texts, some texts at a time."""
    keys, texts = batch.column(0).to_pylist(), batch.column(1)
    at = 0
    while at < len(keys):
        group, size = [], 0
        while at + len(group) < len(keys) and size < most:
            group.append(texts[at + len(group)].as_py())
            size += len(group[-1])
        yield from zip(keys[at : at + len(group)], encoder.encode_batch(group), strict=True)
        at += len(group)


def _shift_crc(crc: int, zeros: int) -> int:
    """A CRC-32's register after so many zero bytes more, by squaring the one-bit step."""
    step = [0xEDB88320, *[1 << i for i in range(31)]]  # image of each bit under one zero bit
    apply = lambda m, v: functools.reduce(operator.xor, (m[i] for i in range(32) if v >> i & 1), 0)
    bits = zeros * 8
    while bits:
        if bits & 1:
            crc = apply(step, crc)
        step = [apply(step, column) for column in step]
        bits >>= 1
    return crc


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of bytes from the lengths and CRC-32s of their parts, in order."""
    out = 0
    for length, crc in parts:
        out = _shift_crc(out, length) ^ crc
    return out


#: A row a shard: before is the ids of the part before it, within the ids of its first document before it.
FIELDS = "part int, seq int, before long, within long, n_ids long, open boolean, doc_ids binary, known binary, blob binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_ids: int = SHARD_IDS, cache_words: int = CACHE_WORDS, at_once: int = SLICE) -> None:
    """Write the ids of all documents to path, in ascending doc_id order of (part, seq) and within a shard.

    at_once: texts of so many code points in all, or one text, are cut into words together.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # The last key tells repeated rows apart, so that a hot doc_id is dealt to many ranges.
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in FIELDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer, cache_words), TaskContext.get().partitionId()
        vocabulary = encoder.tokenizer.get_vocab_size(with_added_tokens=True)
        end = np.array([end_id], dtype=np.uint16)
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        seq = before = within = held = 0

        def flush(open_end: bool) -> pa.RecordBatch:
            lengths = np.array([len(x) for x in ids], dtype=np.int64)
            blob = pack(np.concatenate(ids), lengths, vocabulary, end_id)
            known = np.array([k is not None for k in keys])
            raw = np.array([k or 0 for k in keys], dtype="<i8")
            values = [part, seq, before, within, held, open_end, raw.tobytes(), np.packbits(known).tobytes(), blob]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for batch in batches:
            for key, own in _encoded(encoder, batch, at_once):
                own = np.concatenate([own, end])
                if ids and held + len(own) > shard_ids:
                    yield flush(False)
                    seq, before, within, ids, keys, held = seq + 1, before + held, 0, [], [], 0
                done = 0
                while len(own) - done > shard_ids:  # a long document: full shards of its own
                    ids, keys, held, within = [own[done : done + shard_ids]], [key], shard_ids, done
                    yield flush(True)
                    done += shard_ids
                    seq, before, within, ids, keys, held = seq + 1, before + held, done, [], [], 0
                ids.append(own[done:])
                keys.append(key)
                held += len(own) - done
        if ids:
            yield flush(False)
        # The worker may serve other steps next.
        pa.default_memory_pool().release_unused()

    rows.mapInArrow(run, FIELDS).write.parquet(path)


@F.arrow_udf(LongType())
def _joined_crc(parts: pa.Array) -> pa.Array:
    return pa.array([joined_crc([(4 * p["n"], p["crc"]) for p in own]) for own in parts.to_pylist()], pa.int64())


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written shards alone."""
    stored = spark.read.schema(FIELDS).parquet(path)
    # Ids before each part: one row a part, as many as there are write tasks.
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    firsts = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    start = F.col("first") + F.col("before")
    rows = stored.join(F.broadcast(firsts), "part").select(start.alias("start"), "within", "open", "doc_ids", "known", "blob")
    out = "doc_id long, start long, n_tokens long, ids_crc32 long, at long, whole boolean"
    types = [pa.int64()] * 5 + [pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, within, open_end, doc_ids, known, blob = (c[i].as_py() for c in batch.columns)
                shard = Shard(blob)
                ids, lengths = shard.decode().astype("<u4"), shard.lengths.astype(np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[z - n : z]) for z, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                there = np.unpackbits(np.frombuffer(known, np.uint8), count=len(lengths)).astype(bool)
                first, at = start + ends - lengths, np.zeros(len(lengths), np.int64)
                whole = np.ones(len(lengths), bool)
                first[0], at[0], whole[0] = start - within, within, not within
                whole[-1] &= not open_end
                values = [pa.array(np.frombuffer(doc_ids, "<i8"), mask=~there), first, lengths, crc, at, whole]
                names = [f.split()[0] for f in out.split(", ")]
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    found = rows.mapInArrow(run, out).filter("whole").select(*columns)
    # Documents that go on over shards: only these shards are read again, a row each, joined in order; start names the document.
    part = F.struct("at", F.col("n_tokens").alias("n"), F.col("ids_crc32").alias("crc"))
    long = rows.filter("open or within > 0").mapInArrow(run, out).filter("not whole").groupBy("start", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("parts"))
    return found.unionByName(long.select("doc_id", "start", "n_tokens", _joined_crc("parts").alias("ids_crc32")))
