"""Token ids of whole texts with a public byte-level BPE vocabulary, for the packing and token-file operators."""

from __future__ import annotations

import os
import re

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
END = 2
#: Distinct words that a Python worker remembers, before it starts afresh.
REMEMBERED = 1_000_000

#: A text's pieces: blanks and newlines, then what follows up to the next ones. The vocabulary's own pre-tokenizer always cuts
#: where a blank or newline follows something else, so pieces are encoded alone.
PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Other white space may join blanks in one token; such texts are encoded whole.
OTHER_SPACE = re.compile(r"[^\S \n]")


def has_loose_space(text: str) -> bool:
    """Blanks that don't stand alone between words; other texts are cut at each blank."""
    return text[0] == " " or text[-1] == " " or "  " in text or "\n\n" in text or " \n" in text or "\n " in text


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Memory(dict):
    """Numbers of distinct strings, and the ids of each. New strings are numbered at once and encoded together by ``learn``."""

    def __init__(self, encode_many):
        super().__init__()
        self.encode_many, self.new = encode_many, []
        self.flat, self.length, self.begin = np.empty(0, np.uint16), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number

    def numbers(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def learn(self) -> None:
        if self.new:
            flat, length = self.encode_many(self.new)
            self.flat, self.length = np.concatenate([self.flat, flat]), np.concatenate([self.length, length])
            self.begin = np.cumsum(self.length) - self.length
            self.new = []

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        n = self.length[numbers]
        ends = np.cumsum(n)
        if not len(n):
            return np.empty(0, np.uint32)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.begin[numbers] - ends + n, n)].astype(np.uint32)


class Encoder:
    """Encodes texts as the ``tokenizers`` library does, calling it once for each distinct word that a worker meets."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the library cuts out of a text before anything else, such as the end mark. None holds a blank.
        self.cut_out = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose first byte is a blank
        self.starts[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.marks = {m: self._plain([m])[0][0] for m in ",."}
        self.words, self.pieces = Memory(self._words), Memory(self._pieces)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._plain(pieces)
        return np.fromiter((i for x in ids for i in x), np.uint16), np.fromiter(map(len, ids), np.int64, len(ids))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words after a blank. A comma or a full stop after a letter is a token of its own, so each word is encoded without it."""
        mark = np.array([self.marks.get(w[-1], 0) if len(w) > 1 and w[-2].isalpha() and w[-2] < "\u0250" else 0 for w in words], np.uint16)
        bare: dict[str, int] = {}
        numbers = np.fromiter((bare.setdefault(w[:-1] if m else w, len(bare)) for w, m in zip(words, mark.tolist(), strict=True)), np.int64, len(words))
        flat, length = self._bare(list(bare))
        begin = np.cumsum(length) - length
        n = length[numbers]
        whole = n + (mark > 0)
        ends = np.cumsum(whole)
        out = np.empty(ends[-1], np.uint16)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[at + np.repeat(ends - whole, n)] = flat[at + np.repeat(begin[numbers], n)]
        out[ends[mark > 0] - 1] = mark[mark > 0]
        return out, whole

    def _bare(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words to a call: an id with a leading blank begins each."""
        flats, lengths = [], []
        groups = [words[k : k + 64] for k in range(0, len(words), 64)]
        for group, ids in zip(groups, self._plain([" " + " ".join(g) for g in groups]), strict=True):
            flat = np.array(ids, np.uint16)
            first = np.flatnonzero(self.starts[flat])
            if len(first) == len(group) and first[0] == 0:
                length = np.diff(np.r_[first, len(flat)])
            else:
                flat, length = self._pieces([" " + w for w in group])
            flats.append(flat)
            lengths.append(length)
        return np.concatenate(flats), np.concatenate(lengths)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Arrays of ids as uint32; null counts as empty."""
        for name, how in (("words", self._words), ("pieces", self._pieces)):
            if len(getattr(self, name)) > REMEMBERED:
                setattr(self, name, Memory(how))
        empty, parts, heads = np.empty(0, np.uint32), [], []
        for t in texts:
            if not t:
                parts.append((None, empty))
            elif OTHER_SPACE.search(t) or any(c in t for c in self.cut_out):
                parts.append((None, np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)))
            elif has_loose_space(t):
                parts.append((self.pieces, self.pieces.numbers(PIECES.findall(t))))
            else:
                head, *rest = t.split(" ")
                heads.append(head)
                parts.append((self.words, self.words.numbers(rest)))
        self.words.learn()
        self.pieces.learn()
        first = iter(self._plain(heads))
        out = []
        for memory, x in parts:
            if memory is None:
                out.append(x)
            elif memory is self.pieces:
                out.append(memory.ids(x))
            else:
                out.append(np.concatenate([np.array(next(first), np.uint32), memory.ids(x)]))
        return out


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker, which tasks share."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
