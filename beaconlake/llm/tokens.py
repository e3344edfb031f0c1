"""Encoding of whole texts with public tokenizers.

``SpanEncoder`` gives the places of a whole text's tokens, which follow from the tokens' bytes. ``WordEncoder`` only gives the ids, of a tokenizer
that drops white space and never joins characters across it. Both tokenizers merge characters within the pieces of their
pre-tokenizer only, so the ids of a text are those of its pieces, in order; each distinct piece goes through the tokenizers
library once in a worker, many pieces in one call, as a text with a token of its own between them. Pieces are told here where
all characters are plain (ASCII, Latin letters and signs that no normalizer joins); what lies between white space and has others goes to the
library as it is. Long pieces aren't kept.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np

from .common import KEPT

#: Characters of a piece that is kept, pieces encoded by one call, pieces of one text, and the word between them.
LONGEST, AT_ONCE, JOINED, MARK = 64, 1 << 10, 1 << 6, "\u2605"

#: Plain characters: letters, whose lower case is one plain letter, and signs (neither letters, numbers nor white space); with 0-9 and white space.
LETTERS, SIGNS, SPACES = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f", r"!-/:-@\[-`{-~\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027\u2030-\u205e\u20a0-\u20bf", r" \t\n\r"
_PLAIN = re.compile(f"[{LETTERS}0-9{SIGNS}{SPACES}]*+")
_OTHER_SPACE = re.compile(rf"[^\S{SPACES}]")
_ODD = f"[{LETTERS}0-9{SIGNS}]*+[^{LETTERS}0-9{SIGNS}{SPACES}]"
_SHORT = "'(?:s|t|re|ve|m|ll|d)"

#: The pre-tokenizers' pieces of plain texts, and, in other texts, the runs between white space that have other characters (with the white space before them where pieces have it).
_WORDS, _ODD_WORDS = re.compile(f"{_SHORT}|[{LETTERS}]+|[0-9]|[{SIGNS}]+"), re.compile(f"(?<![^{SPACES}])({_ODD}[^{SPACES}]*+)")
_SPANS, _ODD_SPANS = re.compile(f"{_SHORT}| ?[{LETTERS}]+| ?[0-9]+| ?[{SIGNS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"), re.compile(f"(?:\\A|(?<=[^{SPACES}])(?=[{SPACES}]))([{SPACES}]*+{_ODD}[^{SPACES}]*+)")

#: What a tokenizer must be for _WORDS.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUT = [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Pieces:
    """Ids of texts as little-endian 32-bit bytes, by their pieces. most: pieces that are kept, about 200 bytes each."""

    def __init__(self, path: str, most: int):
        self.tokenizer, self.known, self.most = _load(path), {"": b""}, most
        self.added = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]

    def _pieces(self, text: str) -> list[str]:
        raise NotImplementedError

    def _each(self, pieces: list[str]) -> list[bytes]:
        raise NotImplementedError

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _in_runs(self, pieces: list[str], between: str, mark: int | None, ids_of: Callable[[list[str]], list[np.ndarray]]) -> list[bytes]:
        """Ids of each of the pieces, which are encoded as texts of JOINED; one by one where a piece has the mark itself."""
        if mark is None:
            return [x.tobytes() for x in ids_of(pieces)]
        runs, out = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)], []
        for run, ids in zip(runs, ids_of([between.join(run) for run in runs]), strict=True):
            at = np.flatnonzero(ids == mark).tolist()
            if len(at) + 1 == len(run):
                whole = ids.tobytes()
                out += [whole[4 * a : 4 * b] for a, b in zip([0, *(x + 1 for x in at)], [*at, len(ids)], strict=True)]
            else:
                out += [x.tobytes() for x in ids_of(run)]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        split = [self._pieces(t) for t in texts]
        flat = list(chain.from_iterable(split))
        if len(self.known) > self.most:
            self.known = {"": b""}
        known = self.known
        found = list(map(known.get, flat))
        if None in found:
            lacking = [i for i, x in enumerate(found) if x is None]
            new = list({flat[i] for i in lacking})
            for i in range(0, len(new), AT_ONCE):
                some = new[i : i + AT_ONCE]
                known.update(zip(some, self._each(some), strict=True))
            for i in lacking:
                found[i] = known[flat[i]]
            for c in new:
                if len(c) > LONGEST:
                    del known[c]
        out, at = [], 0
        for pieces in split:
            out.append(b"".join(found[at : at + len(pieces)]))
            at += len(pieces)
        return out


class WordEncoder(_Pieces):
    """For a tokenizer that drops white space: ids of a text as little-endian 32-bit bytes. most: pieces that are kept, about 200 bytes each."""

    def __init__(self, path: str, most: int = 1 << 20):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__(path, most)
        mark = self._ids([MARK])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None
        is_ = json.loads(self.tokenizer.to_str())
        self.plain = None
        if (is_["normalizer"] or {}).get("normalizers") == _NORMAL and (is_["pre_tokenizer"] or {}).get("pretokenizers") == _CUT and not is_["post_processor"]:
            self.plain = Tokenizer(self.tokenizer.model)  # for pieces of plain lower-case characters, which nothing else changes
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _has_added(self, text: str) -> bool:
        return any(a in text for a in self.added)

    def _pieces(self, text: str) -> list[str]:
        if self.plain is None or self._has_added(text):
            return text.replace("\n", " ").split(" ")
        if text.isascii() and text.isprintable() or _PLAIN.fullmatch(text):
            return _WORDS.findall(text.lower())
        out = []
        for k, part in enumerate(_ODD_WORDS.split(text)):
            out += [part] if k % 2 else _WORDS.findall(part.lower())
        return out

    def _each(self, pieces: list[str]) -> list[bytes]:
        if self.plain is None:
            return self._in_runs(pieces, f" {MARK} ", self.mark, self._ids)
        plain = [_WORDS.fullmatch(p) is not None and p == p.lower() and not self._has_added(p) for p in pieces]
        a, b = (iter(self._in_runs([p for p, x in zip(pieces, plain, strict=True) if x == kind], f" {MARK} ", self.mark, f)) for kind, f in ((True, self._plain_ids), (False, self._ids)))
        return [next(a if x else b) for x in plain]

    def _plain_ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.ids(texts)


class SpanEncoder(_Pieces):
    """First character of each token of a whole text, its end, and its id, as arrays.

    Tokens of a byte-level vocabulary that drops, adds and changes nothing lie end to end, a byte for each character of a
    token's name, so their places follow from the ids. Other tokenizers are asked for their offsets."""

    def __init__(self, path: str, most: int = 1 << 19):
        from tokenizers import pre_tokenizers

        super().__init__(path, most)
        t, added = self.tokenizer, self.tokenizer.get_added_tokens_decoder()
        pre = t.pre_tokenizer
        bytewise = isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and t.normalizer is None and t.post_processor is None
        plain = bytewise and t.truncation is None and t.padding is None and t.model.unk_token is None and not any(a.lstrip or a.rstrip for a in added.values())
        self.sizes = None
        if plain and set(pre_tokenizers.ByteLevel.alphabet()) <= t.get_vocab(False).keys():
            names = t.get_vocab(False)
            self.sizes = np.zeros(1 + max([*names.values(), *added]), np.int64)
            for name, i in names.items():
                self.sizes[i] = len(name)
            for i, a in added.items():
                self.sizes[i] = len(a.content.encode())
        self.by_pieces = self.sizes is not None and pre.use_regex
        self.between, self.mark = next(((a.content, i) for i, a in added.items() if not a.single_word), ("", None))

    def _pieces(self, text: str) -> list[str]:
        if not self.by_pieces or any(a in text for a in self.added):
            return [text]
        if text.isascii() and text.isprintable() or _PLAIN.fullmatch(text):
            return _SPANS.findall(text)
        if _OTHER_SPACE.search(text):
            return [text]
        out = []
        for k, part in enumerate(_ODD_SPANS.split(text)):
            out += [part] if k % 2 else _SPANS.findall(part)
        return out

    def _each(self, pieces: list[str]) -> list[bytes]:
        return self._in_runs(pieces, self.between, self.mark, self._ids)

    def encode(self, text: str) -> np.ndarray:
        return self.spans([text])[0]

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """[token, (id, first character, last character plus one)] of each text."""
        if self.sizes is None:
            return [self._offsets(t) for t in texts]
        return [self._places(t, np.frombuffer(ids, "<u4")) for t, ids in zip(texts, self.ids(texts), strict=True)]

    def _offsets(self, text: str) -> np.ndarray:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        out = np.empty((len(e.ids), 3), np.int64)
        out[:, 0] = e.ids
        out[:, 1:] = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(out)).reshape(-1, 2)
        return out

    def _places(self, text: str, ids: np.ndarray) -> np.ndarray:
        out = np.empty((len(ids), 3), np.int64)
        out[:, 0] = ids
        size = self.sizes[out[:, 0]]
        out[:, 2] = np.cumsum(size)
        out[:, 1] = out[:, 2] - size
        if not text.isascii():  # characters of the first and the last byte
            of = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
            out[:, 1], out[:, 2] = of[out[:, 1]], of[out[:, 2] - 1] + 1
        return out


_encoders: dict = {}
KEPT["encoders"] = _encoders.clear


def encoder(kind: type, path: str, *options):
    if (kind, path, *options) not in _encoders:
        _encoders[kind, path, *options] = kind(path, *options)
    return _encoders[kind, path, *options]
