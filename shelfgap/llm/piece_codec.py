"""SentencePiece encoding that keeps source offsets, and decoding.

Normalisation goes through the model's compiled character map: at each place
the longest prefix that the map knows is replaced, any other character stays.
Every character of the normalised text records the source byte it came from,
so each piece is projected to a span of bytes of the original text.

Merges never reach over a word's start where no piece holds a word mark behind
another character, so words are merged by themselves and remembered.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from . import textkit as tk

MARK = "▁"              # stands for a space in pieces
BAD = "�"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6   # fixed values: types of pieces
MEMO_WORDS = 300_000         # words that a worker remembers
LONG_CHARS = 256             # longer words are merged by themselves
CHUNK_BYTES = 1 << 20        # of text that is encoded between two emissions


class CharMap:
    """A compiled character map: a double-array trie of byte strings, and what each is replaced by.

    A unit of the trie holds its byte, the way to its children and whether a
    value ends there.
    """

    def __init__(self, blob: bytes):
        self.units, self.strings = [], b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.strings = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix of ``data`` from ``at``."""
        if not self.units:
            return None
        units, best = self.units, None
        node = self._children(0, units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node = self._children(node, unit)
            if unit >> 8 & 1:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        end = self.strings.index(b"\0", best[1])
        return best[0], self.strings[best[1]:end]

    @staticmethod
    def _children(node: int, unit: int) -> int:
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))


class Normaliser:
    """A text as the model sees it, with the source byte of each character."""

    def __init__(self, charsmap: bytes, dummy_prefix: bool, remove_extra: bool, escape: bool):
        self.map = CharMap(charsmap)
        self.dummy, self.remove_extra, self.space = dummy_prefix, remove_extra, MARK if escape else " "
        self.plain = not charsmap and not remove_extra

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, source byte of each of its characters and, last, the end)."""
        if not text:
            return "", np.zeros(1, np.int64)
        return self._plain(text) if self.plain else self._mapped(text.encode())

    def _plain(self, text: str) -> tuple[str, np.ndarray]:
        data = np.frombuffer(text.encode(), np.uint8)
        starts = np.flatnonzero((data & 0xC0) != 0x80) if len(data) != len(text) else np.arange(len(data))
        head = [0] if self.dummy else []
        return self.space * len(head) + text.replace(" ", self.space), np.concatenate((head, starts, [len(data)])).astype(np.int64)

    def _steps(self, data: bytes) -> Iterator[tuple[int, int, str]]:
        """(start, end, replacement) of each step through the source."""
        at = 0
        while at < len(data):
            known = self.map.longest(data, at)
            if known:
                to, new = at + known[0], known[1].decode()
            else:
                to = at + 1
                while to < len(data) and data[to] & 0xC0 == 0x80:
                    to += 1
                new = data[at:to].decode()
            yield at, to, new
            at = to

    def _mapped(self, data: bytes) -> tuple[str, np.ndarray]:
        out: list[str] = []
        source: list[int] = []
        end = 0                     # where the source of the last kept character ends
        after_space = self.remove_extra
        for start, to, new in self._steps(data):
            if after_space:
                new = new.lstrip(" ")
            if not new:
                if not out:
                    end = to        # white space at the start belongs to no character
                continue
            if not out and self.dummy:
                out.append(self.space)
                source.append(start)
            out += new.replace(" ", self.space)
            source += [start] * len(new)
            after_space = self.remove_extra and new.endswith(" ")
            end = to
        if self.remove_extra:
            while out and out[-1] == self.space:
                out.pop()
                end = source.pop()
        return "".join(out), np.array([*source, end if out else 0], np.int64)


class _Merger:
    """Byte-pair merges of many words at once.

    Each round merges in every word its best-ranked neighbours, the leftmost
    among equals; a word without any leaves the rounds.  Symbols are ids of
    pieces; characters that are no piece have a number beyond them if a piece
    holds them, else -1.
    """

    def __init__(self, pieces: dict[str, int], rank: dict[str, float], n_pieces: int):
        self.n_pieces = n_pieces
        extra = sorted({c for p in pieces for c in p} - set(pieces))
        symbol = pieces | {c: n_pieces + i for i, c in enumerate(extra)}
        self.char = np.full(0x110000, -1, np.int32)
        for piece, number in symbol.items():
            if len(piece) == 1:
                self.char[ord(piece)] = number
        self.width = n_pieces + len(extra)
        order = {score: i for i, score in enumerate(sorted(set(rank.values())))}
        found = sorted((symbol[p[:i]] * self.width + symbol[p[i:]], order[rank[p]], number)
                       for p, number in pieces.items() for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol)
        columns = np.array([*found, (np.iinfo(np.int64).max, len(order), 0)], np.int64)
        self.key, self.rank, self.merged = columns[:, 0].copy(), columns[:, 1].astype(np.int32), columns[:, 2].astype(np.int32)
        self.never = np.int32(len(order))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.key, key)
        known = (self.key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.rank[at], self.never), self.merged[at]

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, their first characters in the words' joint text, symbols of each word)."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol, first = self.char[codes], np.arange(len(codes))
        own = np.repeat(np.arange(len(words)), lengths)
        rank, merged = np.full(len(codes), self.never), np.zeros(len(codes), np.int32)
        at = np.flatnonzero(own[1:] == own[:-1])
        rank[at], merged[at] = self._pairs(symbol[at], symbol[at + 1])
        done_symbol, done_first = [], []
        while len(symbol):
            starts = tk.group_starts(own)
            sizes = np.diff(np.append(starts, len(own)))
            best = np.minimum.reduceat(rank, starts)
            alive = np.repeat(best < self.never, sizes)
            at = np.flatnonzero((rank == np.repeat(best, sizes)) & alive)
            at = at[np.concatenate(([True], own[at[1:]] != own[at[:-1]]))] if len(at) else at
            symbol[at] = merged[at]
            done_symbol.append(symbol[~alive])
            done_first.append(first[~alive])
            keep = alive
            keep[at + 1] = False
            place = (np.cumsum(keep) - 1)[at]
            symbol, own, first, rank, merged = (x[keep] for x in (symbol, own, first, rank, merged))
            near = np.concatenate((place, place[place > 0] - 1))
            rank[near] = self.never
            near = near[near + 1 < len(own)]
            near = near[own[near] == own[near + 1]]
            rank[near], merged[near] = self._pairs(symbol[near], symbol[near + 1])
        symbol, first = np.concatenate([*done_symbol, symbol]), np.concatenate([*done_first, first])
        order = np.argsort(first)
        symbol, first = symbol[order], first[order]
        ends = np.cumsum(lengths)
        return symbol, first, np.diff(np.searchsorted(first, np.concatenate(([0], ends))))


class _Places(dict):
    """Word -> its place; a new word gets the next one and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        place = self[word] = len(self)
        return place


class _Words:
    """Words with their ids and the characters of each piece, as places in growing arrays.

    Forgets all words when there are more than MEMO_WORDS.
    """

    def __init__(self, merge):
        self.merge = merge
        self.clear()

    def clear(self):
        self.place = _Places()
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.chars = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def look_up(self, words: list[str]) -> np.ndarray:
        """The words' places, new ones merged."""
        if len(self.place) > MEMO_WORDS or len(self.ids) > 8 * MEMO_WORDS:
            self.clear()
        found = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if self.place.new:
            new, self.place.new = self.place.new, []
            ids, chars, count = self.merge(new)
            self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(count) - count))
            self.count = np.concatenate((self.count, count))
            self.ids, self.chars = np.concatenate((self.ids, ids)), np.concatenate((self.chars, chars))
        return found


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places starts[i] .. starts[i] + counts[i] - 1 of all i, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Codec:
    """A byte-pair model with byte fallback; ``blob`` is the model file's content."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        model.ParseFromString(blob)
        spec, trainer = model.normalizer_spec, model.trainer_spec
        types = {p.type for p in model.pieces}
        if (trainer.model_type != 2 or not trainer.byte_fallback or types - {NORMAL, UNKNOWN, CONTROL, BYTE}
                or trainer.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap):
            raise ValueError("only byte-pair models with byte fallback and without own or unused pieces are read")
        self.normalise = Normaliser(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces,
                                    spec.escape_whitespaces)
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        inside = any(MARK in p.lstrip(MARK) for p in self.rank)
        self.word = re.compile("(?s).+" if inside else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.merger = _Merger(self.id, self.rank, len(model.pieces))
        self.words = _Words(self._merge)
        self.strip = spec.add_dummy_prefix or spec.remove_extra_whitespaces
        self.strip_all = spec.remove_extra_whitespaces
        self._surfaces(model, trainer.unk_surface)

    def _surfaces(self, model, unknown: str):
        """Bytes of each id in a text, one after the other."""
        special = {CONTROL: lambda p: b"", UNKNOWN: lambda p: unknown.encode(),
                   BYTE: lambda p: bytes([int(p.piece[1:-1], 16)])}
        own = [special.get(p.type, lambda p: p.piece.replace(MARK, " ").encode())(p) for p in model.pieces]
        self.type = np.array([p.type for p in model.pieces], np.uint8)
        self.width = np.array([len(s) for s in own], np.int64)
        self.place = np.concatenate(([0], np.cumsum(self.width)))[:-1]
        self.bytes = np.frombuffer(b"".join(own), np.uint8)
        self.spaced = np.array([p.type == NORMAL and p.piece.startswith(MARK) for p in model.pieces])

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words' pieces, characters of each and pieces of each word.

        A character that the model lacks becomes its bytes, of which the last counts it.
        """
        long = [i for i, w in enumerate(words) if len(w) > LONG_CHARS]
        short = [w for w in words if len(w) <= LONG_CHARS] if long else words
        symbol, first, count = self.merger(short)
        parts = [self._spelt(symbol, np.diff(np.append(first, sum(map(len, short)))), "".join(short), first, count)]
        if not long:
            return parts[0]
        for i in long:
            pieces = _merge_long(words[i], self.rank)
            ends = np.cumsum([len(x) for x in pieces])
            symbol = np.array([self.id.get(x, -1) for x in pieces])
            parts.append(self._spelt(symbol, np.diff(ends, prepend=0), words[i], np.concatenate(([0], ends))[:-1],
                                     np.array([len(pieces)])))
        # the long ones go back to their places
        ids, chars, count = (np.concatenate(x) for x in zip(*parts))
        place = np.concatenate((np.delete(np.arange(len(words)), long), long))
        order = np.argsort(place)
        at = ragged((np.cumsum(count) - count)[order], count[order])
        return ids[at], chars[at], count[order]

    def _spelt(self, symbol, chars, text: str, first, count) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        unknown = (symbol < 0) | (symbol >= self.merger.n_pieces)
        if not unknown.any():
            return symbol.astype(np.int32), chars.astype(np.int32), count
        own = [[self.byte[b] for b in text[i].encode()] for i in first[unknown].tolist()]
        size = np.ones(len(symbol), np.int64)
        size[unknown] = [len(x) for x in own]
        ends = np.cumsum(size)
        ids, out = np.repeat(symbol, size), np.zeros(ends[-1], np.int64)
        out[ends - 1] = chars
        ids[np.repeat(unknown, size)] = [b for x in own for b in x]
        bounds = np.concatenate(([0], np.cumsum(count)))
        return ids.astype(np.int32), out.astype(np.int32), np.diff(np.concatenate(([0], ends))[bounds])

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the start and end of each piece in its text's UTF-8 bytes, and each text's pieces."""
        seen, source = zip(*map(self.normalise, texts))
        words = [self.word.findall(t) for t in seen]
        at = self.words.look_up([w for ws in words for w in ws])
        counts = self.words.count[at]
        place = ragged(self.words.start[at], counts)
        ids, ends = self.words.ids[place], np.cumsum(self.words.chars[place], dtype=np.int64)
        pieces = np.concatenate(([0], np.cumsum(counts)))[np.cumsum([0, *map(len, words)])]
        # a text's source has one place more than it has characters
        shift = np.repeat(np.arange(len(texts)), np.diff(pieces))
        source = np.concatenate(source)
        starts = np.concatenate(([0], ends))[:-1]
        return ids, source[starts + shift], source[ends + shift], np.diff(pieces)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the start and end of each piece in the text's UTF-8 bytes."""
        return self.encode_all([text])[:3]

    def decode(self, ids: np.ndarray) -> str:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        if ids.min() < 0 or ids.max() >= len(self.type):
            raise ValueError("ids are from 0 to less than the number of pieces")
        width, place = self.width[ids], self.place[ids]
        if self.strip:
            for i in np.flatnonzero(self.type[ids] != CONTROL).tolist():
                if not self.spaced[ids[i]]:
                    break
                width[i], place[i] = width[i] - 1, place[i] + 1
                if width[i] or not self.strip_all:
                    break
        ends = np.cumsum(width)
        data = self.bytes[np.arange(ends[-1]) + np.repeat(place - ends + width, width)].tobytes()
        if not (self.type[ids] == CONTROL).any():      # which part runs of byte pieces
            try:
                return data.decode()
            except UnicodeDecodeError:
                pass
        return self._decode_runs(ids, data, ends, width)

    def _decode_runs(self, ids, data, ends, width) -> str:
        """Runs of byte pieces by themselves; each byte that is part of no character is replaced."""
        single = self.type[ids] == BYTE
        edges = [0, *(np.flatnonzero(single[1:] != single[:-1]) + 1).tolist(), len(ids)]
        out = []
        for a, b in zip(edges, edges[1:]):
            run = data[ends[a] - width[a]:ends[b - 1]]
            out.append(_lenient(run) if single[a] else run.decode())
        return "".join(out)


def _merge_long(word: str, rank: dict[str, float]) -> list[str]:
    """Pieces of a word of any length, by a queue of neighbours."""
    n = len(word)
    size = [1] * n              # 0: merged into a piece before
    back, onward = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [(rank[word[i:i + 2]], i, i + 1, 2) for i in range(n - 1) if word[i:i + 2] in rank]
    heapq.heapify(queue)
    while queue:
        _, left, right, both = heapq.heappop(queue)
        if not size[left] or not size[right] or size[left] + size[right] != both:
            continue
        size[left], size[right] = both, 0
        after = onward[left] = onward[right]
        if after < n:
            back[after] = left
            if (found := rank.get(word[left:left + both + size[after]])) is not None:
                heapq.heappush(queue, (found, left, after, both + size[after]))
        before = back[left]
        if before >= 0 and (found := rank.get(word[before:left + both])) is not None:
            heapq.heappush(queue, (found, before, left, size[before] + both))
    return [word[i:i + size[i]] for i in range(n) if size[i]]


def _lenient(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        for n in range(1, 5):
            try:
                out.append(run[at:at + n].decode())
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append(BAD)
            n = 1
        at += n
    return "".join(out)


def _shared(rows: DataFrame, model_path: str):
    """The model file's content, broadcast, with room for what a worker makes of it."""
    with open(model_path, "rb") as f:
        return rows.sparkSession.sparkContext.broadcast({"model": f.read()})


def _codec(shared) -> Codec:
    """A worker keeps what is broadcast from task to task, and so the codec and the words it remembers."""
    held = shared.value
    if "codec" not in held:
        held["codec"] = Codec(held["model"])
    return held["codec"]


def _fields(rows: DataFrame, leave_out: str | None = None) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != leave_out)


def encode(docs: DataFrame, model_path: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The input's rows with ``ids``, ``starts`` and ``ends`` (array<int>); without the text unless ``keep_text``.

    Ids equal the library's plain encoding without begin or end ids.  A piece
    stands for the bytes ``starts`` to ``ends`` of the text; of the bytes of a
    character that the model lacks, the last has its span and the others have
    an empty one.  The model is read at the driver and broadcast (its size is
    the model file's).

    Null and empty texts have empty lists.  Texts are encoded whole, however
    long.  Each row is encoded by itself, so repeated rows get equal results.
    Empty tables give an empty result.  Other columns keep names and values;
    where the input has columns ``ids``, ``starts`` or ``ends`` a ValueError
    says so.
    """
    names = ("ids", "starts", "ends")
    if set(names) & set(docs.columns):
        raise ValueError(f"rename the columns {names} first")
    shared, place = _shared(docs, model_path), docs.columns.index(text)

    def run(it):
        codec = _codec(shared)
        for batch in it:
            texts = batch.column(place)
            _, offsets = tk.binary_parts(texts)
            kept = batch if keep_text else batch.drop_columns([text])
            for a, b in tk.doc_chunks(offsets, CHUNK_BYTES):
                ids, starts, ends, pieces = codec.encode_all([t or "" for t in texts.slice(a, b - a).to_pylist()])
                bounds = pa.array(np.concatenate(([0], np.cumsum(pieces))), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(c.astype(np.int32))) for c in (ids, starts, ends)]
                yield pa.RecordBatch.from_arrays([*kept.slice(a, b - a).columns, *lists],
                                                 names=[*kept.schema.names, *names])

    return docs.mapInArrow(run, _fields(docs, None if keep_text else text)
                           + "ids array<int>, starts array<int>, ends array<int>")


def decode(rows: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The input's rows with the text of their ids in column ``out``, which takes the place of the ids.

    Null and empty lists give an empty text, null ids are left out, and bytes
    that form no character become U+FFFD.  Ids that the model lacks are an
    error.  Rows keep their other columns; empty tables give an empty result.
    """
    if out in rows.columns and out != ids:
        raise ValueError(f"rename the column {out} first")
    shared, place = _shared(rows, model_path), rows.columns.index(ids)

    def run(it):
        codec = _codec(shared)
        for batch in it:
            lists, kept = batch.column(place), batch.drop_columns([ids])
            sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)
            for a, b in tk.doc_chunks(np.concatenate(([0], np.cumsum(sizes))), CHUNK_BYTES):
                texts = [codec.decode(x.values.drop_null().to_numpy(zero_copy_only=False)) if x.is_valid else ""
                         for x in lists.slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([*kept.slice(a, b - a).columns, pa.array(texts, pa.string())],
                                                 names=[*kept.schema.names, out])

    return rows.mapInArrow(run, _fields(rows, ids) + f"`{out}` string")
