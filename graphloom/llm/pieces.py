"""SentencePiece encoding and decoding of whole texts, by an own agenda of symbol pairs.

For merge-type vocabularies (BPE): the symbols of a text are its characters; an agenda holds the
adjacent pairs whose union is a piece, best score first and leftmost among equals; the top pair
is merged and its new neighbours join the agenda, until it is empty.  Symbols that are no piece
become their bytes, or the unknown id where the vocabulary has no bytes.

No merge crosses two neighbouring characters that no piece of the vocabulary holds side by side,
so a text is cut there into chunks (words, digits, line ends), and a worker keeps the ids of
chunks it has met.  Every chunk that enters the table is checked against the sentencepiece
library, a batch at a time; a difference raises.  Texts are normalised by the library.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.agenda import PairAgenda
from graphloom.llm.common import ship, slices

SPACE = "▁"

# Piece types and the model type as the model file numbers them (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a serialised message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceEncoder:
    """Encodes texts to ids exactly as the sentencepiece library does, without sampling."""

    def __init__(self, path: str | None = None, most: int = 300_000, longest: int = 64):
        """path: model file (default: the public piece_bpe_32k.model); most: chunks kept, beyond
        which the table starts anew; longest: characters of a chunk that is kept."""
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most, self.longest = most, longest
        self.known: dict[str, bytes] = {}
        self._read_vocabulary()
        self._find_cuts()
        self._rank_pairs()

    def _read_vocabulary(self) -> None:
        model = list(_fields(self.library.serialized_model_proto()))
        trainer = dict(_fields(next((v for k, v in model if k == 2), b"")))
        if trainer.get(3, 1) != MERGES:
            raise ValueError("the vocabulary is not of the merge type")
        self.ids: dict[str, int] = {}  # pieces that merges may make
        self.scores: dict[str, float] = {}
        self.unused: set[str] = set()
        self.own: list[str] = []  # symbols that are never split or merged
        self.bytes: dict[int, int] = {}
        for number, message in enumerate(v for k, v in model if k == 1):
            kind = dict(_fields(message)).get(3, NORMAL)
            piece = self.library.id_to_piece(number)
            if kind == BYTE:
                self.bytes[int(piece[3:5], 16)] = number
            elif kind in (NORMAL, USER_DEFINED, UNUSED):
                self.ids[piece], self.scores[piece] = number, self.library.get_score(number)
                if kind == UNUSED:
                    self.unused.add(piece)
                if kind == USER_DEFINED:
                    self.own.append(piece)
        self.own_form = re.compile("|".join(map(re.escape, sorted(self.own, key=len, reverse=True)))) if self.own else None

    def _find_cuts(self) -> None:
        """The pattern of chunks; None if pieces may run across words."""
        long = [p for p in self.ids if len(p) > 1]
        # Characters of ASCII without neighbours in any piece stand alone.
        self.lone = sorted({chr(c) for c in range(128)} - set("".join(long)))
        across = any(SPACE in p.lstrip(SPACE) for p in long)
        alone = "".join(map(re.escape, self.lone))
        some = f"[{alone}]|" if alone else ""
        self.form = None if across else re.compile(f"{some}{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk of normalised text."""
        symbols: list[str] = []
        frozen: set[int] = set()
        at = 0
        while at < len(chunk):
            own = self.own_form.match(chunk, at) if self.own_form else None
            if own:
                frozen.add(len(symbols))
            symbols.append(own.group() if own else chunk[at])
            at += len(symbols[-1])
        count = len(symbols)
        before, after = list(range(-1, count - 1)), [*range(1, count), -1]
        agenda: list[tuple[float, int, int, int]] = []
        parts: dict[str, tuple[str, str]] = {}  # how an unused piece came about

        def offer(left: int, right: int) -> None:
            if left < 0 or right < 0 or left in frozen or right in frozen:
                return
            union = symbols[left] + symbols[right]
            score = self.scores.get(union)
            if score is not None:
                heapq.heappush(agenda, (-score, left, right, len(union)))
                if union in self.unused:
                    parts[union] = (symbols[left], symbols[right])

        for left in range(count - 1):
            offer(left, left + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size:
                continue  # one of the two has been merged since
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])

        ids: list[int] = []
        rest = [s for s in reversed(symbols) if s]
        while rest:
            symbol = rest.pop()
            if symbol in self.unused and symbol in parts:
                rest += reversed(parts[symbol])
            elif symbol in self.ids:
                ids.append(self.ids[symbol])
            elif self.bytes:
                ids += [self.bytes[b] for b in symbol.encode()]
            else:
                ids.append(self.library.unk_id())
        return ids

    def _rank_pairs(self) -> None:
        """For `_merge_together`: the symbol of each character, and an agenda of all pairs of symbols whose
        union is a piece, ranked by its score; equal scores share a rank."""
        size = self.library.vocab_size()
        # A character that is no piece is a symbol beyond the vocabulary.
        self.symbol_of = np.arange(size, size + 0x110000, dtype=np.int64)
        for piece, number in self.ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = number
        levels = {s: n for n, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for piece, number in self.ids.items():
            for at in range(1, len(piece)):
                sides = [
                    int(self.symbol_of[ord(side)]) if len(side) == 1 else self.ids.get(side, -1)
                    for side in (piece[:at], piece[at:])
                ]
                if min(sides) >= 0:
                    pairs[sides[0], sides[1]] = (number, levels[self.scores[piece]])
        self.agenda = PairAgenda(pairs)

    def _merge_together(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of chunks, whose agendas advance together; chunks longer than `longest` go through `merge`."""
        size = self.library.vocab_size()
        out: list[bytes] = [b""] * len(chunks)
        lengths = np.array([len(c) for c in chunks], dtype=np.int64)
        for row in np.flatnonzero(lengths > self.longest).tolist():
            out[row] = np.array(self.merge(chunks[row]), dtype="<i4").tobytes()

        def start(rows: np.ndarray, count: int) -> np.ndarray:
            text = "".join([chunks[r] for r in rows.tolist()]).encode("utf-32-le")
            return self.symbol_of[np.frombuffer(text, "<u4")].reshape(len(rows), count)

        def done(rows: np.ndarray, symbols: np.ndarray) -> None:
            if symbols.max() < size:
                packed, step = symbols.astype("<i4").tobytes(), 4 * symbols.shape[1]
                for n, row in enumerate(rows.tolist()):
                    out[row] = packed[step * n : step * (n + 1)]
            else:
                for row, some in zip(rows.tolist(), symbols.tolist()):
                    out[row] = self._with_bytes(some)

        self.agenda.run(np.where(lengths > self.longest, 0, lengths), start, done)
        return out

    def _with_bytes(self, symbols: list[int]) -> bytes:
        """Packed ids of symbols, characters that are no piece as their bytes or the unknown id."""
        ids: list[int] = []
        size = self.library.vocab_size()
        for symbol in symbols:
            if symbol < size:
                ids.append(symbol)
            elif self.bytes:
                ids += [self.bytes[b] for b in chr(symbol - size).encode()]
            else:
                ids.append(self.library.unk_id())
        return np.array(ids, dtype="<i4").tobytes()

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Packed ids of new chunks, checked against the library in one call."""
        if not chunks:
            return {}
        # Pieces that are split again or never merged need the agenda of one chunk.
        if self.own or self.unused:
            found = [np.array(self.merge(c), dtype="<i4").tobytes() for c in chunks]
        else:
            found = self._merge_together(chunks)
        if self.lone:
            # A lone character between two chunks keeps them apart in the library too.
            mark = "\n" if "\n" in self.lone else self.lone[0]
            apart = np.array(self.merge(mark), dtype="<i4").tobytes()
            # The library puts a space before a text.
            start = np.array(self.merge(self.library.normalize(mark)[: -len(mark)]), dtype="<i4").tobytes()
            given = np.frombuffer(start + b"".join([apart + ids for ids in found]), "<i4")
            expected = self.library.encode(mark + mark.join(chunks))
            if not np.array_equal(self._settled(given), np.array(expected)):
                raise ValueError("ids differ from those of the sentencepiece library")
        return dict(zip(chunks, found))

    def _settled(self, ids: np.ndarray) -> np.ndarray:
        """A run of unknown ids is one where the vocabulary has no bytes."""
        if self.bytes or not len(ids):
            return ids
        unknown = ids == self.library.unk_id()
        return ids[~(unknown & np.concatenate([[False], unknown[:-1]]))]

    def encode(self, texts: list[str], whole_check: bool = False) -> list[np.ndarray]:
        """Ids of each text.  whole_check: also compares whole texts with the library."""
        cut = [self.form.findall(t) if self.form else [t] for t in map(self.library.normalize, texts)]
        new: set[str] = set()
        for chunks in cut:
            new.update(chunks)
        new = {c for c in new if c not in self.known}
        if len(self.known) + len(new) > self.most:
            self.known = {}
            new = {c for chunks in cut for c in chunks}
        found = self._learn(list(new))
        long = {c: ids for c, ids in found.items() if len(c) > self.longest}
        self.known.update(found)
        look = self.known.__getitem__
        out = [self._settled(np.frombuffer(b"".join(map(look, chunks)), "<i4")) for chunks in cut]
        for chunk in long:
            del self.known[chunk]
        if whole_check or not self.lone or self.form is None:
            for ids, expected in zip(out, self.library.encode(texts, num_threads=1)):
                if ids.tolist() != expected:
                    raise ValueError("ids differ from those of the sentencepiece library")
        return out


_encoders: dict[str | None, PieceEncoder] = {}


def encoder(path: str | None) -> PieceEncoder:
    """The worker's encoder, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _texts(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in column.to_pylist()]


def encode(
    docs: DataFrame,
    text: str = "text",
    name: str = "ids",
    decoded: str | None = None,
    model: str | None = None,
    start_id: bool = False,
    end_id: bool = True,
    whole_check: bool = False,
) -> DataFrame:
    """Adds the ids of each whole text as `name` (array<int>), and as `decoded` what the
    sentencepiece library decodes from them.

    One pass without a shuffle; rows and other columns stay as they are, and a column that is
    already called `name` or `decoded` is replaced.  Null and empty texts have the start and end ids
    alone and decode to the empty text; bytes that are not UTF-8 count as U+FFFD; equal rows get equal
    ids; an empty table gives an empty one.  Texts of any length are encoded whole: a
    batch holds about 4 MB of text, or one longer text.  model: model file on every worker.
    """
    ship(docs.sparkSession)
    added = [name] + ([decoded] if decoded else [])
    kept = [c for c in docs.columns if c not in added and c != text]
    # The text comes twice: as a column to keep and as bytes to read.
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias("_gl_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    fields += f", `{name}` array<int>" + (f", `{decoded}` string" if decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(model)
        first = np.array([pieces.library.bos_id()] if start_id else [], dtype="<i4")
        last = np.array([pieces.library.eos_id()] if end_id else [], dtype="<i4")
        for batch in slices(batches, "_gl_text"):
            texts = _texts(batch.column("_gl_text"))
            ids = [np.concatenate([first, found, last]) for found in pieces.encode(texts, whole_check)]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "<i4"), *ids])))
            out = [*batch.columns, lists]
            if decoded:
                out.append(pa.array(pieces.library.decode([i.tolist() for i in ids], num_threads=1), pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *added])

    done = source.mapInArrow(run, fields)
    back = [F.col("_gl_text").cast("string").alias(text)] if text not in added else []
    return done.select(*[F.col(f"`{c}`") for c in kept], *back, *[F.col(f"`{c}`") for c in added])


def decode(docs: DataFrame, ids: str = "ids", name: str = "text", model: str | None = None) -> DataFrame:
    """Adds the text of each list of ids as `name`, by the sentencepiece library.

    Null lists, and lists with a null or an id outside the vocabulary, give null.  A column that is already called `name` is
    replaced.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != name]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + f", `{name}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(model).library
        size = library.vocab_size()

        def valid(some: list[int | None] | None) -> bool:
            return some is not None and all(i is not None and 0 <= i < size for i in some)

        for batch in batches:
            lists = batch.column(ids).to_pylist()
            good = [some if valid(some) else [] for some in lists]
            texts = library.decode(good, num_threads=1) if good else []
            out = [t if valid(some) else None for t, some in zip(texts, lists)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*kept, name])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, fields)
