"""Token ids of whole texts by the tokenizers library, encoding each distinct word once per worker.

A tokenizer with word ends drops white space and never joins text across it, so the ids of a text
are the ids of its words (parted at ASCII white space) one after another.  Arrow splits a batch and numbers
its distinct words; these are looked up or encoded, and their ids are taken for every word.  Words are
kept up to a number; beyond it the table starts anew.  Texts of other tokenizers are encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from graphloom.llm.agenda import PairAgenda

# Texts of printable ASCII and Latin-1 letters are brought to fewer distinct words first: case of
# ASCII letters is dropped by the tokenizer, and a run of marks is split from letters and digits.
# An apostrophe may open a contraction, so runs beside one stay where they are; "<|" may open a
# special token, and other characters may compose, so such texts are left as they are.
_PLAIN = bytes([9, 10, 11, 12, 13, *range(32, 127)])
_WORD = bytes([9, 10, 11, 12, 13, 32, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_RUN = re.compile(rb"""[!-/:-@\[-`{-~]{2}""")
_RUNS = re.compile(rb"""(?<![!-/:-@\[-`{-~])([!-&(-/:-@\[-`{-~]++)(?!')""")
# Words of small letters of ASCII and Latin-1 are one unit of the tokenizer, in its normal form already.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf]){1,64}")
_SIGNS = (b"\xc3\x97", b"\xc3\xb7")  # the two signs among the Latin-1 letters
_MARK = " \x01 "


class WordEncoder:
    """Encodes texts to packed little-endian unsigned 32-bit ids; equal to encoding the whole text."""

    def __init__(self, path: str | None = None, most: int = 600_000):
        """path: tokenizer file (default: the public word_bpe_49k.json); most: cached words."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.words: dict[bytes, bytes] = {}
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.by_words = self._parts_words()
        if self.by_words:
            self._rank_pairs()

    def _parts_words(self) -> bool:
        """True if the tokenizer lower-cases, drops white space and ends its words, as `spaced` expects."""
        kinds = lambda part: [x["type"] for x in (part or {}).get("normalizers") or (part or {}).get("pretokenizers") or []]
        parts = json.loads(self.tokenizer.to_str())
        cut = ((parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        return (
            kinds(parts["normalizer"]) == ["NFC", "Replace", "Lowercase"]
            and kinds(parts["pre_tokenizer"]) == ["Split", "ByteLevel"]
            and (cut.get("behavior"), cut.get("invert")) == ("Removed", True)
            and bool(parts["model"].get("end_of_word_suffix"))
        )

    def _rank_pairs(self) -> None:
        """The merges of the vocabulary as an agenda over ids; a last byte has an id with the word's end."""
        model = json.loads(self.tokenizer.to_str())["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        # Bytes that are no printable character stand for characters from 256 on, in order.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in printable]
        letter = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(hidden)}
        self.inner = np.array([ids[letter[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([ids[letter[b] + end] for b in range(256)], dtype=np.int64)
        pairs = {}
        for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pairs[ids[left], ids[right]] = (ids[left + right], rank)
        self.agenda = PairAgenda(pairs)

    def _merge_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of small letters, by an agenda of their byte pairs."""
        out: list[bytes] = [b""] * len(words)

        def start(rows: np.ndarray, count: int) -> np.ndarray:
            letters = np.frombuffer(b"".join([words[r] for r in rows.tolist()]), np.uint8).reshape(len(rows), count)
            symbols = self.inner[letters]
            symbols[:, -1] = self.last[letters[:, -1]]
            return symbols

        def done(rows: np.ndarray, symbols: np.ndarray) -> None:
            packed, step = symbols.astype("<u4").tobytes(), 4 * symbols.shape[1]
            for n, row in enumerate(rows.tolist()):
                out[row] = packed[step * n : step * (n + 1)]

        self.agenda.run(np.array([len(w) for w in words], dtype=np.int64), start, done)
        return out

    def _encode_new(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words; those of letters alone are merged together, others go to the library."""
        plain = [bool(_LETTERS.fullmatch(w)) for w in words]
        merged = iter(self._merge_words([w for w, p in zip(words, plain) if p]))
        others = iter(self._encode_by_library([w for w, p in zip(words, plain) if not p]))
        return [next(merged) if p else next(others) for p in plain]

    def _encode_by_library(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, many per call with a mark between them."""
        if not words:
            return []
        texts = [w.decode("utf-8", "replace") for w in words]
        if self.mark is None:
            return [self._packed(t) for t in texts]
        groups = [texts[i : i + 256] for i in range(0, len(texts), 256)]
        joined = self.tokenizer.encode_batch_fast([_MARK.join(g) for g in groups], add_special_tokens=False)
        out: list[bytes] = []
        for group, found in zip(groups, joined):
            ids = np.array(found.ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(group) - 1:  # a word holds the mark itself
                out += [self._packed(t) for t in group]
                continue
            packed = ids.tobytes()
            starts = [0, *((cuts + 1) * 4).tolist()]
            ends = [*(cuts * 4).tolist(), len(packed)]
            out += [packed[a:b] for a, b in zip(starts, ends)]
        return out

    def _packed(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    @staticmethod
    def spaced(text: bytes) -> bytes:
        """The text with spaces at which its ids may be cut."""
        rest = text.translate(None, _PLAIN)
        plain = not rest or (len(rest) % 2 == 0 and not rest[::2].strip(b"\xc3") and not any(x in text for x in _SIGNS))
        if plain and b"<|" not in text:
            text = text.lower()
            marks = set(text.translate(None, _WORD))
            if 39 in marks or _RUN.search(text):
                text = _RUNS.sub(rb" \1 ", text)
            else:  # single marks
                for mark in marks:
                    text = text.replace(b"%c" % mark, b" %c " % mark)
        return text

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Packed ids of each text (null: none)."""
        if not self.by_words:
            return [self._packed(t.decode("utf-8", "replace")) if t else b"" for t in texts]
        if not texts:
            return []
        # Bytes that are not UTF-8 pass through: Arrow splits at ASCII characters alone.
        spaced = pa.array([self.spaced(t) if t else b"" for t in texts], pa.binary()).view(pa.string())
        words = pc.ascii_split_whitespace(spaced)
        numbered = words.values.dictionary_encode()
        distinct = numbered.dictionary.view(pa.binary()).to_pylist()
        fresh = [w for w in distinct if w not in self.words]
        if len(self.words) + len(fresh) > self.most:
            self.words, fresh = {}, distinct
        self.words.update(zip(fresh, self._encode_new(fresh)))
        known = list(map(self.words.__getitem__, distinct))
        ends = np.cumsum([0, *map(len, known)]) // 4
        ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(known), "<i4")))
        taken = ids.take(numbered.indices)
        packed = memoryview(taken.values.to_numpy()).cast("B")
        cuts = (taken.offsets.to_numpy()[words.offsets.to_numpy()] * 4).tolist()
        return [bytes(packed[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


_encoders: dict[str | None, WordEncoder] = {}


def encoder(path: str | None) -> WordEncoder:
    """The worker's encoder, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
