"""Best-fit packing of documents into training sequences, improved by local search.

Documents become token ids; only those longer than a sequence are cut. Full pieces
are sequences of their own. The others are dealt by hash into
groups of a bounded number of tokens. A group is packed by best fit in decreasing order of length, then a
swap-based search works on the bins with room: it empties the least filled one by moving a document into
another bin, exchanging one document for one, or two for one, each step putting more
into the fuller bin so that the sum of squared fills grows and the search ends. Bins that
are still not nearly full are released and regrouped with those of other groups, until one group is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplylens.llm.columns import PLAIN, distinct_words, release_memory, text_stretches
from supplylens.llm.common import cut

CAPACITY = 4096
PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids a Python worker remembers; beyond that it goes on with those of its last stretch of texts.
KNOWN_WORDS = 800_000
#: Bytes of text that are encoded at once.
ENCODED_AT_ONCE = 8_000_000
#: Marks split off from the end of a word. No apostrophe: it can start a piece with the letters after it.
MARKS = ".,;:!?|#$%&*()[]{}<>=+/\\-\""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary lower-cases, drops white space and never joins what it separates, so texts are split into words, and each different
    word is encoded once. Splitting, telling words apart and putting ids together are Arrow operations on whole columns. Marks at
    the end of a word of plain letters make pieces of their own and are looked up apart. Unknown words of plain letters are encoded many at
    a time and told apart by the ids that end a word; other words are encoded whole. Texts with a special token's
    string, in any case, never pass through words at all.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, words: pa.Array, chunk: int = 500) -> pa.Array:
        """Ids of words of plain letters."""
        n = len(words)
        at = pa.array(np.append(np.arange(0, n, chunk), n), pa.int32())
        lines = pc.binary_join(pa.ListArray.from_arrays(at, words), " ").to_pylist()
        out = []
        for i, e in enumerate(self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            size = min(chunk, n - i * chunk)
            if len(ends) == size:
                offsets = np.concatenate([[0], ends * 4]).astype(np.int64)
                out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), size, [None, pa.py_buffer(offsets), pa.py_buffer(ids)]))
            else:
                out.append(pa.array(self._whole(words.slice(i * chunk, size).to_pylist()), pa.large_binary()))
        return pa.concat_arrays(out)

    def _learn(self, new: pa.Array) -> tuple[pa.Array, pa.Array]:
        plain = pc.match_substring_regex(new, f"^[{PLAIN}]+$")
        some, other = new.filter(plain), new.filter(pc.invert(plain))
        found = [self._plain(some)] if len(some) else []
        if len(other):
            found.append(pa.array(self._whole(other.to_pylist()), pa.large_binary()))
        return pa.concat_arrays([some, other]), pa.concat_arrays(found)

    def _look_up(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            new, ids = self._learn(words.filter(pc.is_null(at)))
            if len(self.words) + len(new) > KNOWN_WORDS:
                kept = at.drop_null()
                self.words, self.ids = self.words.take(kept), self.ids.take(kept)
            self.words, self.ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, ids])
            at = pc.index_in(words, value_set=self.words)
        return self.ids.take(at)

    def _distinct(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words with the marks behind them."""
        core = pc.ascii_rtrim(words, characters=MARKS)
        apart = pc.match_substring_regex(core, f"^[{PLAIN}]+$")
        cut_off = pc.and_(apart, pc.less(pc.binary_length(core), pc.binary_length(words)))
        cores = pc.if_else(cut_off, core, words).dictionary_encode()
        tails = pa.array([w[n:] if c else "" for w, n, c in zip(words.to_pylist(), pc.utf8_length(core).to_pylist(), cut_off.to_pylist())], pa.string()).dictionary_encode()
        tail_ids = pa.array(self._whole(tails.dictionary.to_pylist()), pa.large_binary())
        return pc.binary_join_element_wise(self._look_up(cores.dictionary).take(cores.indices), tail_ids.take(tails.indices), pa.scalar(b"", pa.large_binary()))

    def encode_column(self, texts: pa.Array) -> list[memoryview | bytes]:
        """Ids of each text of a column of strings without nulls."""
        lower = pc.ascii_lower(texts)
        odd = pc.match_substring(lower, "<|")
        if pc.any(odd).as_py():
            odd = pa.array([o and any(s in t for s in self.special) for o, t in zip(odd.to_pylist(), lower.to_pylist())], pa.bool_())
            lower = pc.if_else(odd, "", lower)
        first, index, words = distinct_words(lower)
        if not len(index):
            out: list = [b""] * len(texts)
        else:
            ids = self._distinct(words).take(pa.array(index))
            at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1][first].tolist()
            data = memoryview(ids.buffers()[2] or b"")
            out = [data[a:b] for a, b in zip(at, at[1:])]
        if pc.any(odd).as_py():
            for i in np.flatnonzero(np.asarray(odd)).tolist():
                out[i] = self._whole([texts[i].as_py()])[0]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [bytes(x) for x in self.encode_column(pa.array(texts, pa.string()))]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: row_id, doc_id, piece, start, length, ids_crc32 (and ids as binary where asked for)."""
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip([c.split()[0] for c in PIECES.split(", ")] + ["ids"], types))[: 7 if with_ids else 6])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            rows, docs_ = batch["row_id"].to_pylist(), batch["doc_id"].to_pylist()
            for lo, hi, texts in text_stretches(batch["text"], ENCODED_AT_ONCE):
                out: list[tuple] = []
                for row, doc, ids in zip(rows[lo:hi], docs_[lo:hi], enc.encode_column(texts)):
                    n = len(ids) + 4
                    for k, at in enumerate(range(0, n, step)):
                        piece = ids[at : at + step]
                        crc, size, last = zlib.crc32(piece), len(piece), at + step >= n
                        if last:  # the end token, which can be a piece of its own
                            crc, size = zlib.crc32(end, crc), size + 4
                        out.append((row, doc, k, at // 4, size // 4, crc, (bytes(piece) + end * last if with_ids else None)))
                columns = list(zip(*out)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        release_memory()

    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut_up, PIECES + (", ids binary" if with_ids else ""))


class Bins:
    """Bins of one group during packing and local search. Items are indices into ``sizes``."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes = sizes
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Best fit decreasing. Bins are kept by free space; the bits of an integer say which spaces occur."""
        by_space: dict[int, list[int]] = {}
        spaces = 0
        for i in np.argsort(-self.sizes, kind="stable").tolist():
            size = int(self.sizes[i])
            fitting = spaces >> size
            if fitting:
                space = size + (fitting & -fitting).bit_length() - 1
                bin_ = by_space[space].pop()
                if not by_space[space]:
                    spaces ^= 1 << space
                self.items[bin_].append(i)
                self.fill[bin_] += size
            else:
                space, bin_ = self.capacity, len(self.items)
                self.items.append([i])
                self.fill.append(size)
            left = space - size
            by_space.setdefault(left, []).append(bin_)
            if left:  # nothing fits into a full bin
                spaces |= 1 << left

    def fewest(self) -> int:
        return -(-int(self.sizes.sum()) // self.capacity)

    def improve(self) -> None:
        """Empty bins one after another, from the least filled, until none can be emptied or none is superfluous."""
        live = {b for b in range(len(self.items)) if self.items[b]}
        stuck: set[int] = set()
        while len(live) > self.fewest():
            candidates = [b for b in live if b not in stuck and self.fill[b] < self.capacity]
            if not candidates:
                break
            victim = min(candidates, key=lambda b: (self.fill[b], b))
            if self._shrink(victim, live):
                live.discard(victim)
                stuck.clear()
            else:
                stuck.add(victim)

    def _shrink(self, victim: int, live: set[int]) -> bool:
        """Move the victim's contents into fuller bins with room as far as the three moves reach; True if it is empty then."""
        while self.items[victim]:
            others = [b for b in live if b != victim and self.capacity > self.fill[b] >= self.fill[victim]]
            if not others:
                return False
            room = np.array([self.capacity - self.fill[b] for b in others])
            if not (self._move(victim, others, room) or self._swap(victim, others, room) or self._swap_two(victim, others, room)):
                return False
        return True

    def _apply(self, victim: int, give: list[int], other: int, take: list[int]) -> None:
        for i in give:
            self.items[victim].remove(i)
        for i in take:
            self.items[other].remove(i)
        self.items[other].extend(give)
        self.items[victim].extend(take)
        gain = int(sum(self.sizes[i] for i in give) - sum(self.sizes[i] for i in take))
        self.fill[other] += gain
        self.fill[victim] -= gain

    def _move(self, victim: int, others: list[int], room: np.ndarray) -> bool:
        for i in sorted(self.items[victim], key=lambda i: -self.sizes[i]):
            fits = np.where(room >= self.sizes[i], room, self.capacity + 1)
            k = int(fits.argmin())
            if fits[k] <= self.capacity:
                self._apply(victim, [i], others[k], [])
                return True
        return False

    def _flat(self, others: list[int], room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        item = np.array([i for b in others for i in self.items[b]])
        at = np.repeat(np.arange(len(others)), [len(self.items[b]) for b in others])
        return item, at

    def _swap(self, victim: int, others: list[int], room: np.ndarray) -> bool:
        """A larger document of the victim for a smaller one elsewhere: the exchange that fills a bin most."""
        item, at = self._flat(others, room)
        best = (0, -1, -1)
        for i in self.items[victim]:
            gain = self.sizes[i] - self.sizes[item]
            gain = np.where(gain <= room[at], gain, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (int(gain[k]), i, k)
        if best[0] <= 0:
            return False
        self._apply(victim, [best[1]], others[at[best[2]]], [int(item[best[2]])])
        return True

    def _swap_two(self, victim: int, others: list[int], room: np.ndarray) -> bool:
        """Two documents of the victim for one elsewhere, or one of the victim for two."""
        item, at = self._flat(others, room)
        best: tuple = (0,)
        mine = sorted(self.items[victim], key=lambda i: -self.sizes[i])
        for a in range(len(mine)):
            for b in range(a + 1, len(mine)):
                gain = self.sizes[mine[a]] + self.sizes[mine[b]] - self.sizes[item]
                gain = np.where(gain <= room[at], gain, 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (int(gain[k]), [mine[a], mine[b]], others[at[k]], [int(item[k])])
        for n, bin_ in enumerate(others):
            theirs = self.items[bin_]
            if len(theirs) < 2:
                continue
            sizes = self.sizes[theirs]
            first, second = np.triu_indices(len(theirs), 1)
            pair = sizes[first] + sizes[second]
            for i in mine:
                gain = np.where(self.sizes[i] - pair <= room[n], self.sizes[i] - pair, 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (int(gain[k]), [i], bin_, [theirs[first[k]], theirs[second[k]]])
        if best[0] <= 0:
            return False
        self._apply(victim, best[1], best[2], best[3])
        return True


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it and the bin's fill for each size (all from 1 to ``capacity``)."""
    bins = Bins(np.asarray(sizes, dtype=np.int64), capacity)
    bins.best_fit()
    bins.improve()
    bin_of, offset, fill = (np.zeros(len(sizes), dtype=np.int64) for _ in range(3))
    for n, (items, full) in enumerate(zip(bins.items, bins.fill)):
        at = 0
        for i in items:
            bin_of[i], offset[i], fill[i] = n, at, full
            at += int(bins.sizes[i])
    return bin_of, offset, fill


def _placer(level: int, capacity: int):
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_id", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        bin_of, offset, fill = pack_sizes(pdf["length"].to_numpy(), capacity)
        # level, group and bin in one number; a group never has 2 ** 32 bins.
        pdf["sequence_id"] = (level << 56) + pdf["group"].to_numpy(dtype="int64") * (1 << 32) + bin_of
        pdf["offset"], pdf["fill"] = offset, fill
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf.drop(columns="group")

    return place


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    end_id: int = 1,
    capacity: int = CAPACITY,
    group_tokens: int = 8_000_000,
    release_below: float = 0.995,
    with_ids: bool = False,
) -> DataFrame:
    """Place every piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    * a null or empty text is a document of the end token alone; very long texts are cut into full pieces and a rest;
    * a null id stays null, repeated rows are packed each on its own; an empty table gives no rows;
    * only ``doc_id`` and ``text`` are read, so extra columns never clash; pieces of one length tie by a hash of id and text;
    * ``group_tokens`` bounds what one task packs, ``release_below`` says from which fill a bin is
      final before the last round.
    """
    pieces = cut(pieces_of(docs.select("doc_id", "text"), tokenizer_path or default_tokenizer(), end_id, capacity, with_ids))
    # Numbers are stable over the checkpoint. Groups are chosen by them as well as by content, so copies of one row spread over all groups.
    pieces = pieces.withColumn("number", F.monotonically_increasing_id())
    names = [c for c in pieces.columns if c not in ("row_id", "number")]
    full = pieces.filter(F.col("length") == capacity)
    # Negative numbers keep these apart from packed bins.
    done = [full.select(*names, (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = pieces.filter(F.col("length") < capacity)
    types = {f.name: f.dataType.simpleString() for f in pieces.schema}
    out = ", ".join(f"{c} {types[c]}" for c in pieces.columns) + ", sequence_id long, offset long, fill long"
    last_groups, level = None, 0
    while True:
        tokens, n = rest.agg(F.sum("length"), F.count("*")).first()
        if not n:
            break
        groups = max(1, -(-tokens // group_tokens))
        final = groups == 1 or (last_groups is not None and groups >= last_groups)

        grouped = rest.withColumn("group", F.pmod(F.xxhash64("row_id", "piece", "number", F.lit(level)), F.lit(groups)))
        placed = grouped.groupBy("group").applyInPandas(_placer(level, capacity), out)
        if not final:
            placed = cut(placed)
            open_ = F.col("fill") < F.lit(int(release_below * capacity))
            done.append(placed.filter(~open_).select(*names, "sequence_id", "offset"))
            rest = placed.filter(open_).select(*pieces.columns)
        else:
            done.append(placed.select(*names, "sequence_id", "offset"))
            break
        last_groups, level = groups, level + 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result
