"""Exact tokenizer ids of whole texts through a cache of pieces.

A text is cut where the public BPE tokenizers always end a pre-token: at a single space or line feed between two
visible characters, or, for the word tokenizer, at any ASCII white space. All pieces of a batch are told apart by
64-bit hashes of their bytes; each new one is encoded once a worker by the tokenizers library, many at a time: the
merges of the tokenizer's own file run over a row of pre-tokens with a symbol between them that no merge knows.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import SPACES, span_hashes, word_spans

#: A Latin word and the marks after it, or marks alone: pre-tokens that need no asking.
_PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)")

#: Byte-level pre-tokens spell a byte that is not printable as the next character from U+0100 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SPACE, _FEED = _BYTES[32], _BYTES[10]
#: Symbols of no merge (private use): after a pre-token and after a piece; their ids; where the last characters of words go.
_NEXT, _STOP, _NEXT_ID, _STOP_ID, _LAST = "\uF8FE", "\uF8FF", 1 << 30, (1 << 30) + 1, 0xE000
#: Pieces a row, and rows a call.
_ROW, _ROWS = 128, 64
#: White space beyond ASCII, in UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")


def _spelt(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)


class Merges:
    """The merges of a tokenizer file over many pieces in one call of the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # A word's last character with its end mark becomes one character, so that rows of words can be merged at once.
        end = self.end = model.get("end_of_word_suffix") or ""
        name = (lambda s: s[: -len(end) - 1] + chr(_LAST + ord(s[-len(end) - 1])) if s.endswith(end) and len(s) > len(end) else s) if end else str
        vocab = {name(s): i for s, i in model["vocab"].items()}
        merges = [tuple(map(name, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.model = Tokenizer(BPE(vocab | {_NEXT: _NEXT_ID, _STOP: _STOP_ID}, merges))

    def closed(self, token: str) -> str:
        """A pre-token (byte-level spelling) as the model takes it."""
        return token[:-1] + chr(_LAST + ord(token[-1])) if self.end and token else token

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, end to end, and the count of each. A piece: its closed pre-tokens with _NEXT between."""
        ids = [np.zeros(0, np.uint32)]
        step = _ROW * _ROWS
        for i in range(0, len(pieces), step):
            part = pieces[i : i + step]
            rows = [_STOP.join(part[k : k + _ROW]) + _STOP for k in range(0, len(part), _ROW)]
            ids += [np.array(r.ids, np.uint32) for r in self.model.encode_batch_fast(rows, add_special_tokens=False)]
        flat = np.concatenate(ids)
        flat = flat[flat != _NEXT_ID]
        stop = flat == _STOP_ID
        ends = np.flatnonzero(stop)
        return flat[~stop], np.diff(ends, prepend=-1) - 1


class Known:
    """Ids by hash: sorted keys, places and counts in one flat array. New keys wait in a small part of their own."""

    def __init__(self):
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[i] == h, i, -1)

    def add(self, keys: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Takes sorted keys that are not here."""
        i = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, i, keys), np.insert(self.at, i, at), np.insert(self.n, i, n)


class Encoder:
    """Ids of texts by a tokenizer file.

    `lead` says that a pre-token takes the space before it (byte-level BPE); else white space vanishes.
    `added` says that a literal of an added token, like <|endoftext|>, is that token, as the library has it by default;
    else it is ordinary text. Texts that hold one are encoded whole by the library.
    """

    def __init__(self, path: str, lead: bool, limit: int = 2_000_000, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.merges = Merges(path)
        # A pattern of the added tokens, in any case: some are matched after normalisation.
        literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.added = re.compile("|".join(map(re.escape, literals)), re.I) if literals else None
        self.mark = os.path.commonprefix(literals).encode()  # cheap to look for
        self.lead, self.limit = lead, limit
        self.clear()

    def clear(self) -> None:
        self.old, self.new = Known(), Known()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, end to end, and the number of each text's ids."""
        whole = {i: np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, np.uint32) for i, t in enumerate(batch) if self.alone(t)}
        if whole:
            batch = [b"" if i in whole else t for i, t in enumerate(batch)]
        text = b"\n".join(batch) + b"\n"
        data = np.frombuffer(text, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in batch], dtype=np.int64)
        start, size = self.cuts(data, ends) if self.lead else word_spans(data)
        h = span_hashes(data, start, size)
        names, first, which = np.unique(h, return_index=True, return_inverse=True)
        at, n = self.places(names, first, text, start, size)
        at, n = at[which], n[which]
        total = np.cumsum(n)
        ids = self.flat[np.repeat(at - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)]
        # Ids before the end of each text.
        upto = np.concatenate([[0], total])[np.searchsorted(start, ends)]
        counts = np.diff(upto, prepend=0)
        if whole:
            parts = np.split(ids, upto[:-1])
            for i, x in whole.items():
                parts[i], counts[i] = x, len(x)
            ids = np.concatenate(parts)
        return ids, counts

    def alone(self, text: bytes) -> bool:
        """True for a text that holds an added token or, where white space counts, white space beyond ASCII."""
        if self.added and self.mark in text and self.added.search(text.decode()):
            return True
        return self.lead and not text.isascii() and bool(_WIDE_SPACE.search(text))

    @staticmethod
    def cuts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that begin with a single space or line feed between visible characters, or at a text's start."""
        space = SPACES[data]
        here = (data == 32) | (data == 10)
        here[1:] &= ~space[:-1]
        here[:-1] &= ~space[1:]
        here[ends - 1] = False
        begin = np.concatenate([[0], ends[:-1]])
        full = ends - 1 > begin
        here[begin[full]] = True
        start = np.flatnonzero(here)
        # A text's last piece ends before the line feed that joins the texts.
        stop = np.append(start[1:], len(data))
        text = np.searchsorted(ends, start, side="right")
        return start, np.minimum(stop, ends[text] - 1) - start

    def places(self, names: np.ndarray, first: np.ndarray, text: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and count in the flat ids of each distinct piece; unknown ones are encoded first."""
        if len(self.old.keys) + len(self.new.keys) > self.limit:
            self.clear()
        i, j = self.old.find(names), self.new.find(names)
        fresh = np.flatnonzero((i < 0) & (j < 0))
        at, n = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for known, k in ((self.old, i), (self.new, j)):
            ok = k >= 0
            at[ok], n[ok] = known.at[k[ok]], known.n[k[ok]]
        if len(fresh):
            s = start[first[fresh]]
            pieces = [text[a:b].decode() for a, b in zip(s.tolist(), (s + size[first[fresh]]).tolist())]
            ids, counts = self.merges(list(map(self.prepared, pieces)))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            at[fresh], n[fresh] = self.used + np.cumsum(counts) - counts, counts
            self.used += len(ids)
            self.new.add(names[fresh], at[fresh], n[fresh])
            if len(self.new.keys) > 1 << 17:
                self.old.add(self.new.keys, self.new.at, self.new.n)
                self.new = Known()
        return at, n

    def prepared(self, piece: str) -> str:
        """The closed pre-tokens of a piece."""
        m = _PLAIN.fullmatch(piece)
        closed = self.merges.closed
        if m:
            before, word, marks = m.groups()
            if self.lead:
                word = _spelt(word)
                if before == "\n":
                    return _NEXT.join([x for x in (_FEED, word, marks) if x])
                if before:
                    return f"{_SPACE}{word}{_NEXT}{marks}" if word and marks else f"{_SPACE}{word}{marks}"
                return f"{word}{_NEXT}{marks}" if word and marks else word or marks
            if word:
                word = closed(_spelt(word.lower()))
                return f"{word}{_NEXT}{closed(marks)}" if marks else word
            return closed(marks)
        t = self.tokenizer
        return _NEXT.join(closed(x) for x, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(piece) if t.normalizer else piece))


_encoders: dict[tuple[str, bool, bool], Encoder] = {}


def encoder(path: str, lead: bool, added: bool = False) -> Encoder:
    """One encoder a worker process and file: its cache serves all its tasks."""
    if (path, lead, added) not in _encoders:
        _encoders[path, lead, added] = Encoder(path, lead, added=added)
    return _encoders[path, lead, added]


def public_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
