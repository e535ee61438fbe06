"""Token ids of many texts with the tokenizers library, each distinct piece encoded once per worker.

Both vocabularies split a text into pieces at white space before any merge, so the ids of a text are the ids of
its pieces one after the other.  A batch is cut into pieces with vectorised code; new pieces are encoded by the
library and their ids are kept in a bounded table of the worker process.  Texts with white space outside ASCII, and
pieces that are not plain letters and punctuation, go through the library's whole encoder.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

from gridmap.llm.common import SEGMENT_BYTES, slices, span_hashes, word_spans

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Pieces that a worker keeps, about 30 bytes each.
KEPT_PIECES = 3_000_000

#: White space outside ASCII, and control characters that libraries see differently: such texts are encoded whole.
_ODD = re.compile("[" + "".join(map(chr, [0, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028,
                                          0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF])) + "]")
_EDGE = " \t\n\r\x0b\x0c"
_PLAIN = re.compile(r"( ?)([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")
#: The same in ASCII.
_ASCII = re.compile(rb"( ?[A-Za-z]+)([!-&(-/:-@\[-`{-~]*)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable letter: printable bytes as they are, others from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """ids of texts as one flat uint32 array plus lengths; keeps the ids of pieces it has seen."""

    def __init__(self, path: str, spaces: bool, kept: int | None = None):
        """``spaces``: the vocabulary keeps white space (a piece then takes one space before the word along); ``kept``: pieces to keep (None: KEPT_PIECES)."""
        from tokenizers import Tokenizer

        self.tok, self.spaces, self.kept = Tokenizer.from_file(path), spaces, kept
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.letters = _byte_letters()
        self.model, self.marks = self.tok.model, {b"": []}
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.len = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> list[int]:
        """ids of one piece; letters with punctuation after them need no splitting by the library."""
        m = _PLAIN.fullmatch(piece)
        if m and m[2].isalpha() and ord(max(m[2])) < 0x250:
            if self.spaces:
                parts = (m[1] + m[2], m[3])
            elif "İ" not in m[2] and unicodedata.is_normalized("NFC", m[2]):
                parts = (m[2].lower(), m[3])
            else:
                return self.whole(piece)
            return [t.id for p in parts if p for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.letters))]
        return self.whole(piece)

    def _ascii_piece(self, piece: bytes) -> list[int]:
        """ids of one piece; of plain ASCII letters with punctuation after them the letters alone are encoded, short punctuation once."""
        m = _ASCII.fullmatch(piece)
        if not m:
            return self._piece(piece.decode("utf-8", "surrogatepass"))
        word, mark = m[1].decode(), m[2]
        ids = [t.id for t in self.model.tokenize(word.replace(" ", self.letters[32]) if self.spaces else word.strip(" ").lower())]
        if not mark:
            return ids
        after = self.marks.get(mark)
        if after is None:
            after = [t.id for t in self.model.tokenize(mark.decode())]
            if len(mark) <= 2:
                self.marks[mark] = after
        return ids + after

    def _spans(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of texts that neither start nor end with white space, each followed by a line break."""
        starts, ends = word_spans(data)
        if not self.spaces or not len(starts):
            return starts, ends
        # a space right before a word belongs to it; of the white space left, the last character stands alone if it
        # is not such a space, all before it stand together (as in the library's pattern)
        raw = np.frombuffer(data, np.uint8)
        lead = (raw[np.maximum(starts - 1, 0)] == 0x20) & (starts > 0)
        prev, stop = np.concatenate([[0], ends[:-1]]), starts - lead
        alone = ~lead & (stop > prev)
        many = stop - alone > prev
        s = np.concatenate([stop, prev[many], stop[alone] - 1])
        e = np.concatenate([ends, (stop - alone)[many], stop[alone]])
        order = np.argsort(s, kind="stable")
        return s[order], e[order]

    def _learn(self, data: bytes, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        ids = [self._ascii_piece(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for p in ids for x in p), np.uint32, int(lens.sum()))
        if len(self.keys) + len(keys) > (self.kept or KEPT_PIECES):
            self.clear()
        at = len(self.pool) + np.cumsum(lens) - lens
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.len = (np.insert(x, where, y) for x, y in ((self.keys, keys), (self.at, at), (self.len, lens)))
        self.pool = np.concatenate([self.pool, flat])

    def _known(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(raws) + b"\n"
        offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
        s, e = self._spans(data)
        own = ~np.isin(s, offsets[1:] - 1)  # not the line breaks between the texts
        s, e = s[own], e[own]
        keys, first, inv = np.unique(span_hashes(data, s, e), return_index=True, return_inverse=True)
        for _ in range(2):  # again if the table was emptied meanwhile
            new = ~self._known(keys)
            if new.any():
                self._learn(data, keys[new], s[first[new]], e[first[new]])
        where = np.searchsorted(self.keys, keys)
        at, n = self.at[where][inv], self.len[where][inv]
        ends = np.cumsum(n)
        flat = self.pool[np.repeat(at - (ends - n), n) + np.arange(int(n.sum()))]
        return flat, np.diff(np.concatenate([[0], ends])[np.searchsorted(s, offsets)])

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); a null text has none."""
        texts = ["" if t is None else t for t in texts]
        odd = [i for i, t in enumerate(texts)
               if not t or t[0] in _EDGE or t[-1] in _EDGE or len(t) > SEGMENT_BYTES // 4 or _ODD.search(t)]
        parts = {i: np.array(self.whole(texts[i]) if texts[i] else [], np.uint32) for i in odd}
        rest = [i for i in range(len(texts)) if i not in parts]
        for a, b in slices([texts[i] for i in rest]):
            flat, lens = self._plain([texts[i] for i in rest[a:b]])
            parts |= zip(rest[a:b], np.split(flat, np.cumsum(lens)[:-1]))
        lens = np.array([len(parts[i]) for i in range(len(texts))], np.int64)
        flat = np.concatenate([parts[i] for i in range(len(texts))]) if texts else np.zeros(0, np.uint32)
        return flat.astype(np.uint32), lens


_ENCODERS: dict[tuple[str, bool, int | None], PieceEncoder] = {}


def encoder(path: str, spaces: bool, kept: int | None = None) -> PieceEncoder:
    """The worker's encoder for a vocabulary; it and its pieces stay as long as the worker process."""
    if (path, spaces, kept) not in _ENCODERS:
        _ENCODERS[path, spaces, kept] = PieceEncoder(path, spaces, kept)
    return _ENCODERS[path, spaces, kept]
