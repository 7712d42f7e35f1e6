"""SentencePiece BPE with seeded merge-dropout, and its lossless inverse.

A text becomes words that each begin with their spaces. A word's merges wait in an agenda, best score first, then leftmost; a candidate,
that is the spans it would join, is skipped for good where a keyed hash of (seed, document, place, spans) falls below the dropout. The
same document, seed and model thus give the same pieces anywhere. Only the best candidate's hash matters at any time, so that a word's
segmentations are the leaves of a tree of such decisions, which is kept for frequent words; each occurrence walks it by its own hashes.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunks, differing, gather, replaced, space_cuts
from .textkernel import flat, mixed, pieces, word_hashes

#: Longer words are merged by a heap, one at a time; shorter ones all at once.
LONG = 48
#: Slots of words with a tree of decisions, and nodes and ids held before trees start anew.
SLOTS, MOST_NODES, MOST_IDS = 1 << 19, 2 << 20, 3 << 20
SPACE = "▁"
#: Symbols from here on are characters that are no piece, by code point.
OTHER = 0x40000000
_loaded: dict[tuple, Pieces] = {}


def _spans(start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
    u = np.uint64
    return start.astype(u) * u(0x9E3779B97F4A7C15) + mid.astype(u) * u(0xC2B2AE3D27D4EB4F) + end.astype(u) * u(0x165667B19E3779F9)


class Paths:
    """Trees of merge decisions by word. A node is a candidate, with a child for skipping and one for keeping it, or a leaf with ids."""

    def __init__(self, model: Pieces):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.key, self.root = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.n, self.used = 0, 0
        self.span, self.child = np.zeros(1 << 16, np.uint64), np.zeros(2 << 16, np.int32)
        self.off, self.size, self.pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 20, np.int32)

    def _room(self, nodes: int) -> None:
        if self.n + nodes > len(self.span):
            more = max(len(self.span), nodes)
            self.span, self.child = np.append(self.span, np.zeros(more, np.uint64)), np.append(self.child, np.zeros(2 * more, np.int32))
            self.off, self.size = np.append(self.off, np.zeros(more, np.int64)), np.append(self.size, np.zeros(more, np.int32))

    def _hold(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where lists of ids, joined, stand in the pool, and their sizes."""
        total = len(ids)
        if self.used + total > len(self.pool):
            self.pool = np.append(self.pool[: self.used], np.zeros(max(1 << 20, 2 * total), np.int32))
        self.pool[self.used : self.used + total] = ids
        off = self.used + np.cumsum(size) - size
        self.used += total
        return off, size

    def _grow(self, words: list[bytes], places: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """New branches: for each word, as it stands at its place, the nodes behind its first ``depth`` decisions; gives their first nodes."""
        trace: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        found = self.model._together(words, places, trace)
        word, span, keep = (np.concatenate([t[i] for t in trace]) if trace else np.zeros(0, k) for i, k in enumerate((np.int64, np.uint64, bool)))
        order = np.argsort(word, kind="stable")
        word, span, keep = word[order], span[order], keep[order]
        taken = np.bincount(word, minlength=len(words))
        rank = np.arange(len(word)) - (np.cumsum(taken) - taken)[word] - depth[word]
        nodes = taken - depth + 1
        self._room(int(nodes.sum()))
        base = self.n + np.cumsum(nodes) - nodes
        self.n += int(nodes.sum())
        new = rank >= 0
        at = (base[word] + rank)[new]
        self.span[at], self.off[at] = span[new], -1
        self.child[2 * at + keep[new]], self.child[2 * at + ~keep[new]] = at + 1, -1
        leaf = base + nodes - 1
        self.off[leaf], self.size[leaf] = self._hold(*found)
        return base

    def ids(self, data: np.ndarray, at: np.ndarray, cuts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has. places: of each word, the number that its decisions depend on."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        if self.n > MOST_NODES or self.used > MOST_IDS:
            self.clear()
        ends = np.append(cuts[1:], len(data))
        raw = data.tobytes()
        off, size = np.zeros(len(cuts), np.int64), np.zeros(len(cuts), np.int64)
        long = np.flatnonzero(ends - cuts > LONG)
        if len(long):
            found = [self.model.by_heap(raw[cuts[i] : ends[i]], int(places[i])) for i in long.tolist()]
            off[long], size[long] = self._hold(np.array([x for f in found for x in f], np.int32), np.fromiter(map(len, found), np.int64, len(found)))
        short = np.flatnonzero(ends - cuts <= LONG)
        begin, end, place = cuts[short], ends[short], places[short]
        name = word_hashes(data, cuts, ends)[short] | np.uint64(1)
        key, slot = self.model.key_of(place), (name >> np.uint64(17)).astype(np.int64) & (SLOTS - 1)
        at_node, depth = self.root[slot].astype(np.int64), np.zeros(len(short), np.int64)

        def grown(who: np.ndarray) -> np.ndarray:
            parts = [who[lo : lo + 20_000] for lo in range(0, len(who), 20_000)]
            return np.concatenate([self._grow([raw[a:b] for a, b in zip(begin[p].tolist(), end[p].tolist(), strict=True)], place[p], depth[p]) for p in parts])

        new = np.flatnonzero(self.key[slot] != name)
        if len(new):
            one, first, back = np.unique(name[new], return_index=True, return_inverse=True)
            made = grown(new[first])
            at_node[new] = made[back]
            self.key[slot[new[first]]], self.root[slot[new[first]]] = one, made
        live = np.arange(len(short))
        while len(live):
            lost, edges = [], []
            while len(live):
                live = live[self.off[at_node[live]] < 0]
                node = at_node[live]
                edge = 2 * node + (mixed(key[live] ^ self.span[node]) >= self.model.dropout)
                depth[live] += 1
                after = self.child[edge]
                miss = after < 0
                lost.append(live[miss])
                edges.append(edge[miss])
                live = live[~miss]
                at_node[live] = after[~miss]
            live, edge = np.concatenate(lost), np.concatenate(edges)
            if len(live):
                one, first, back = np.unique(edge, return_index=True, return_inverse=True)
                made = grown(live[first])
                self.child[one] = made
                at_node[live] = made[back]
        off[short], size[short] = self.off[at_node], self.size[at_node]
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(cuts, at)]
        return gather(off, size, self.pool), np.diff(upto)


class Pieces:
    """A SentencePiece BPE model as tables: pieces by string, merges by pair, bytes by id."""

    def __init__(self, path: str, dropout: float, seed: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.dropout, self.seed = np.uint64(min(int(dropout * 2.0**64), 2**64 - 1)), seed
        self.score = np.array([model.get_score(i) for i in range(n)])
        self.byte = {bytes([int(names[i][3:5], 16)]): i for i in range(n) if model.is_byte(i)}
        self.normal = {x: i for i, x in enumerate(names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.rank = np.unique(-self.score, return_inverse=True)[1].astype(np.int64) << 32  # by piece: its place in the order of scores
        if len(self.byte) < 256:
            raise ValueError("a model without byte fallback is not lossless")
        if any(SPACE in x.lstrip(SPACE) for x in self.normal):
            raise ValueError("the model has pieces across words")
        self.symbol = np.arange(0x110000, dtype=np.int32) + OTHER  # by code point: characters that are no piece get numbers behind the pieces
        for x, i in self.normal.items():
            if len(x) == 1 and x != SPACE:
                self.symbol[ord(x)] = i
        self.symbol[ord(" ")] = self.normal.get(SPACE, OTHER + ord(" "))
        pairs = sorted((self.normal[x[:k]] * n + self.normal[x[k:]], i) for x, i in self.normal.items() for k in range(1, len(x)) if x[:k] in self.normal and x[k:] in self.normal)
        bits = 1 << max(4, (4 * len(pairs)).bit_length())  # an open table with linear probing
        self.mask, self.pair_key, self.pair_id = bits - 1, np.full(bits, -1, np.int64), np.zeros(bits, np.int32)
        left = np.array([p for p, _ in pairs], np.int64)
        made = np.array([i for _, i in pairs], np.int32)
        slot = self._slot(left)
        while len(left):
            free = self.pair_key[slot] == -1
            self.pair_key[slot[free]] = left[free]
            done = self.pair_key[slot] == left
            self.pair_id[slot[done]] = made[done]
            left, made, slot = left[~done], made[~done], (slot[~done] + 1) & self.mask
        self.n = n
        raw = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.raw_size = np.fromiter(map(len, raw), np.int64, n)
        self.raw_off, self.raw = np.cumsum(self.raw_size) - self.raw_size, np.frombuffer(b"".join(raw), np.uint8)
        self.chunks, self.paths = Chunks(self._encode), Paths(self)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mixed(key.astype(np.uint64)) >> np.uint64(7)).astype(np.int64) & self.mask

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b make, or -1."""
        key = a.astype(np.int64) * self.n + b
        slot, out = self._slot(key), np.full(len(a), -1, np.int32)
        left = np.flatnonzero((a < self.n) & (b < self.n))
        while len(left):
            found = self.pair_key[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self.pair_id[slot[left[hit]]]
            left = left[~hit & (found != -1)]
            slot[left] = (slot[left] + 1) & self.mask
        return out

    def _start(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The characters of all words as symbols, joined, and how many each word has."""
        raw = b"".join(words)
        lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        sizes = np.diff(lead[np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])])
        return self.symbol[np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")].astype(np.int64), sizes

    def _out(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of final symbols, and how many each word has: a character that is no piece becomes its bytes."""
        rare = np.flatnonzero(symbols >= self.n)
        if not len(rare):
            return symbols.astype(np.int32), sizes
        found = [[self.byte[bytes([b])] for b in chr(c).encode()] for c in (symbols[rare] - OTHER).tolist()]
        wide = np.ones(len(symbols), np.int64)
        wide[rare] = list(map(len, found))
        ids = np.repeat(symbols, wide)
        first = np.cumsum(wide) - wide
        for at, own in zip(first[rare].tolist(), found, strict=True):
            ids[at : at + len(own)] = own
        upto = np.concatenate([[0], np.cumsum(wide)])[np.concatenate([[0], np.cumsum(sizes)])]
        return ids.astype(np.int32), np.diff(upto)

    def key_of(self, places: np.ndarray) -> np.ndarray:
        """The keys of decisions at places (a place: a number for document and position)."""
        return mixed(places.astype(np.uint64) ^ mixed(np.full(1, self.seed & (2**64 - 1), np.uint64)))

    def by_heap(self, word: bytes, variant: int) -> list[int]:
        """A word's pieces by an agenda of its own; for words of any length."""
        symbols = self._start([word])[0].tolist()
        size = len(symbols)
        left, right, width = list(range(-1, size - 1)), list(range(1, size + 1)), [1] * size
        agenda: list[tuple[float, int, int, int, int]] = []
        key = self.key_of(np.array([variant], np.int64))

        def offer(where: np.ndarray) -> None:
            """Candidates at symbols and their right neighbours."""
            where = np.array([i for i in where if 0 <= i and right[i] < size], np.int64)
            if not len(where):
                return
            a, b = np.array([symbols[i] for i in where]), np.array([symbols[right[i]] for i in where])
            made = self._merge(a, b)
            mid = where + np.array([width[i] for i in where])
            end = mid + np.array([width[right[i]] for i in where])
            keep = (made >= 0) & ((mixed(key ^ _spans(where, mid, end)) >= self.dropout) | (variant < 0))
            for i, m, mi, en in zip(where[keep].tolist(), made[keep].tolist(), mid[keep].tolist(), end[keep].tolist(), strict=True):
                heapq.heappush(agenda, (-self.score[m], i, mi, en, m))

        offer(np.arange(size - 1))
        while agenda:
            _, i, mid, end, made = heapq.heappop(agenda)
            if symbols[i] < 0 or i + width[i] != mid or right[i] >= size or mid + width[right[i]] != end:
                continue
            j = right[i]
            symbols[i], symbols[j], width[i], right[i] = made, -1, end - i, right[j]
            if right[j] < size:
                left[right[j]] = i
            offer(np.array([left[i], i]))
        left_over = np.array([s for s in symbols if s >= 0], np.int64)
        return self._out(left_over, np.array([len(left_over)]))[0].tolist()

    def _encode(self, words: list[bytes], variants: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out: list = [None] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= LONG]
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = self.by_heap(w, int(variants[k]))
        for lo in range(0, len(short), 20_000):
            own = short[lo : lo + 20_000]
            ids, sizes = self._together([words[k] for k in own], variants[own])
            for k, one in zip(own, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                out[k] = one
        return np.concatenate([np.asarray(x, np.int32) for x in out]), np.fromiter(map(len, out), np.int64, len(out))

    def _together(self, words: list[bytes], variants: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of many short words, joined, and how many each word has: in each round, every word merges or skips its best candidate.
        trace: gets, for each round, words' numbers, their candidates' spans, and whether these were merged."""
        symbol, sizes = self._start(words)
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(symbol)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        stop = place + 1
        key = self.key_of(np.asarray(variants, np.int64))
        plain = variants < 0
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        made = np.full(len(symbol), -1, np.int32)

        def offer(where: np.ndarray) -> None:
            """The candidate of each symbol with its right neighbour, into made."""
            made[where] = -1
            where = where[where < len(symbol) - 1]
            where = where[word[where] == word[where + 1]]
            found = self._merge(symbol[where], symbol[where + 1])
            some = found >= 0
            made[where[some]] = found[some]

        offer(np.arange(len(symbol)))
        while len(symbol):
            some = np.flatnonzero(made >= 0)
            active = np.zeros(len(words), bool)
            active[word.take(some)] = True
            on = active.take(word)
            if not on.all():  # words that are ready leave
                rest = np.flatnonzero(~on)
                done.append((word.take(rest), place.take(rest), symbol.take(rest)))
                on = np.flatnonzero(on)
                word, symbol, place, stop, made = word.take(on), symbol.take(on), place.take(on), stop.take(on), made.take(on)
                some = np.flatnonzero(made >= 0)
            if not len(some):
                break
            owner = word.take(some)  # rising, so that the candidates of a word stand together
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(self.rank.take(made.take(some)) + some, first) & 0xFFFFFFFF
            own, spans = word[best], _spans(place[best], stop[best], stop[best + 1])
            keep = plain[own] | (mixed(key[own] ^ spans) >= self.dropout)
            if trace is not None:
                trace.append((own, spans, keep))
            made[best[~keep]] = -1
            best = best[keep]
            symbol[best], stop[best] = made[best], stop[best + 1]
            on = np.ones(len(symbol), bool)
            on[best + 1] = False
            on = np.flatnonzero(on)
            again = best - np.arange(len(best))  # best is rising: as many symbols before it are gone
            word, symbol, place, stop, made = word.take(on), symbol.take(on), place.take(on), stop.take(on), made.take(on)
            offer(np.concatenate([again, again[again > 0] - 1]))  # a place that comes twice gets the same
        if done:
            w, p, s = (np.concatenate([d[i] for d in done]) for i in range(3))
            order = np.lexsort((p, w))
            w, s = w[order], s[order]
            return self._out(s, np.bincount(w, minlength=len(words)))
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)

    def encode(self, column: pa.Array, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has. keys: decide, with a word's place in its text, which merges are skipped; without them none is."""
        data, at = flat(column)
        full = at[:-1] < at[1:]
        data = np.insert(data, at[:-1][full], 0x20)  # the space before the first word
        at = at + np.concatenate([[0], np.cumsum(full)])
        cuts = space_cuts(data, at)
        if keys is None:
            return self.chunks.ids(data, at, cuts, np.full(len(cuts), -1, np.int64))
        return self.paths.ids(data, at, cuts, self._places(at, cuts, keys))

    def _places(self, at: np.ndarray, cuts: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """A number for each word's text and position."""
        doc = np.searchsorted(at, cuts, "right") - 1
        return (mixed(keys[doc].astype(np.uint64) + np.uint64(0x9E37) * (cuts - at[doc]).astype(np.uint64)) >> np.uint64(1)).astype(np.int64)

    def encode_alone(self, text: bytes, key: int | None) -> np.ndarray:
        """Ids of one text without tables of words: what encode() gives where no two words share a hash."""
        data = np.frombuffer(b" " + text, np.uint8)
        at = np.array([0, len(data)])
        cuts = space_cuts(data, at)
        places = np.full(len(cuts), -1, np.int64) if key is None else self._places(at, cuts, np.array([key], np.uint64))
        ends, raw = [*cuts[1:].tolist(), len(data)], data.tobytes()
        return np.array([i for a, b, p in zip(cuts.tolist(), ends, places.tolist(), strict=True) for i in self.by_heap(raw[a:b], p)], np.int32)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, and how many each has."""
        own = self.raw_size[ids]
        data = gather(self.raw_off[ids], own, self.raw)
        n = np.diff(np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(sizes)])])
        first = (np.cumsum(n) - n)[n > 0]
        return np.delete(data, first), n - (n > 0)


def model_at(path: str, dropout: float, seed: int) -> Pieces:
    if (path, dropout, seed) not in _loaded:
        _loaded.clear()
        _loaded[path, dropout, seed] = Pieces(path, dropout, seed)
    return _loaded[path, dropout, seed]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _encoded(path: str, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path, dropout, seed)
        for batch in batches:
            for lo, hi in pieces(batch.column(1), 1 << 19):
                part = batch.slice(lo, hi - lo)
                texts = part.column(1)
                data, at = flat(texts)
                keys = mixed(part.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.uint64))
                keys = mixed(keys + part.column(2).fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
                ids, sizes = model.encode(texts, keys if dropout > 0 else None)
                wrong = differing(data, at, *model.decode(ids, sizes))
                if wrong:  # two words of one hash: rare, but never let pass
                    ids, sizes = replaced(ids, sizes, {i: model.encode_alone(data[at[i] : at[i + 1]].tobytes(), int(keys[i]) if dropout > 0 else None) for i in wrong})
                    wrong = differing(data, at, *model.decode(ids, sizes))
                same = np.ones(hi - lo, bool)
                same[wrong] = False
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.record_batch([part.column(0), lists, pa.array(sizes, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_ids", "n_bytes", "lossless"])

    return run


def encode_pieces(docs: DataFrame, path: str | None = None, dropout: float = 0.1, seed: int = 20240101, doc_id: str = "doc_id", text: str = "text", turn: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, ids, n_ids, n_bytes, lossless (the ids were decoded and gave the text back, byte for byte).

    ``dropout`` is the share of candidate merges skipped; 0 gives the model's own segmentation. Each occurrence of a word is segmented by
    hashes of its own, by document, place and ``turn``, a column of integers that tells passes over one document apart; without it rows
    equal in doc_id and text have equal pieces. A text that does not come back from its ids is encoded anew without the tables of known
    words. Null and empty texts have no ids. Rows with a null doc_id count as document -1. Special pieces are never made from text;
    U+2581 in a text becomes bytes. Other columns are not read; an empty table gives no rows.
    """
    path = path or default_model()
    turns = F.col(turn).cast("long") if turn else F.lit(0).cast("long")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), turns.alias("turn")).mapInArrow(_encoded(path, dropout, seed), "doc_id long, ids array<int>, n_ids long, n_bytes long, lossless boolean")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path, 0.0, 0)
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            ids, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            data, n = model.decode(ids, sizes)
            raw = data.tobytes()
            ends = np.cumsum(n).tolist()
            yield pa.record_batch([batch.column(0), pa.array([raw[e - k : e].decode(errors="replace") for e, k in zip(ends, n.tolist(), strict=True)], pa.string())], names=["doc_id", "text"])

    return run


def decode_pieces(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path or default_model()), "doc_id long, text string")


def op2(docs: DataFrame) -> DataFrame:
    """All documents' pieces with a tenth of the merges skipped, decoded again."""
    return encode_pieces(docs)
