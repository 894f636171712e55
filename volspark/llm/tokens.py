"""Whole-text token ids through the tokenizers library, with a bounded word cache in each worker."""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np

#: A pre-tokenizer of this pattern drops white space, so words between ASCII spaces are encoded alone.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for words of printable ASCII and Latin letters, ...
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: ... that is, without these: anything else, numerals that aren't digits, the mark of special tokens.
_ODD = re.compile(r"[^!-~\u00a1-\u024f]|[\u00ad\u00b2\u00b3\u00b9\u00bc-\u00be]|<\|")


class WordEncoder:
    """Encodes UTF-8 texts; ids come as little-endian bytes of ``dtype``.

    Where the tokenizer splits on white space, each distinct word is encoded once by the library and
    kept in a cache of two generations, each of at most half of ``cache_words`` words (results do not
    depend on it): a full one becomes the old one, and words still in use return from there. Words with characters beyond Latin, with control characters or with a special
    token's text take the library's full path. For any other tokenizer whole texts are encoded.
    """

    def __init__(self, path: str, cache_words: int = 1_000_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4")
        conf = json.load(open(path, encoding="utf-8"))
        steps = (conf.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norms = [n["type"] for n in (conf.get("normalizer") or {}).get("normalizers") or []]
        suffix = conf["model"].get("end_of_word_suffix")
        plain = {"lstrip": False, "rstrip": False, "single_word": False, "normalized": False}
        self.by_word = (
            steps[0].get("pattern", {}).get("Regex") == WORD_PATTERN
            and steps[0].get("behavior") == "Removed"
            and [s["type"] for s in steps[1:]] == ["ByteLevel"]
            and bool(suffix)
            and norms == ["NFC", "Replace", "Lowercase"]
            and all(t["content"].startswith("<|") for t in conf["added_tokens"])
            and all(t.get(k) == v for t in conf["added_tokens"] for k, v in plain.items())
        )
        self.cache_words = cache_words
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        if self.by_word:
            self.last = np.zeros(self.full.get_vocab_size(), bool)  # ids of tokens that end a word
            for token, i in self.full.get_vocab().items():
                self.last[i] = token.endswith(suffix)
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.full.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, self.dtype).tobytes() for e in found]

    def _learn(self, new: list[bytes]) -> None:
        """Put the ids of words that the cache lacks into it."""
        held, pieces = self.words, self.pieces
        if len(pieces) > self.cache_words // 4:
            pieces.clear()
        one: list[bytes] = []
        only: list[str] = []
        many: list[tuple[bytes, list[str]]] = []
        odd: list[bytes] = []
        for w, s in zip(new, b" ".join(new).decode("utf-8", "replace").lower().split(" ")):
            if s.isascii() and s.isalpha():
                one.append(w)
                only.append(s)
            elif _ODD.search(s):
                odd.append(w)
            elif s.isalpha():
                one.append(w)
                only.append(s)
            else:
                many.append((w, _PIECES.findall(s)))
        wanted = list(dict.fromkeys(x for x in chain(only, chain.from_iterable(p for _, p in many)) if x not in pieces))
        if wanted:
            e = self.bare.encode_batch_fast([wanted], is_pretokenized=True, add_special_tokens=False)[0]
            ids = np.asarray(e.ids, self.dtype)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize).tolist()
            raw = ids.tobytes()
            pieces.update(zip(wanted, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        held.update(zip(one, map(pieces.__getitem__, only)))
        for w, p in many:
            held[w] = b"".join(map(pieces.__getitem__, p))
        if odd:
            held.update(zip(odd, self._whole([w.decode("utf-8", "replace") for w in odd])))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text; a null text counts as empty."""
        if not self.by_word:
            return self._whole([(t or b"").decode("utf-8", "replace") for t in texts])
        split = [(t or b"").split() for t in texts]
        if len(self.words) > self.cache_words // 2:
            self.old, self.words = self.words, {}
        new, held, old = [], self.words, self.old
        for w in set(chain.from_iterable(split)).difference(held):
            if (ids := old.get(w)) is None:
                new.append(w)
            else:
                held[w] = ids
        if new:
            self._learn(new)
        return [b"".join(map(held.__getitem__, ws)) for ws in split]

    def counts(self, texts: list[bytes | None]) -> list[int]:
        return [len(x) // self.dtype.itemsize for x in self.encode(texts)]


_held: dict[str, WordEncoder] = {}


def encoder(path: str, cache_words: int = 1_000_000) -> WordEncoder:
    """One encoder for each tokenizer file and Python worker; its cache has the size asked for last."""
    if path not in _held:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _held[path] = WordEncoder(path, cache_words)
    _held[path].cache_words = cache_words
    return _held[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
