"""Token ids of whole texts, as the tokenizers library gives them for a public vocabulary file."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np

from .shared import kept

#: A word that ends in a letter of ASCII or Latin-1 or a digit, then ASCII marks other than the apostrophe.
_STEM = re.compile(rb"(.*(?:[a-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))([!-&(-/:-@\[-`{-~]+)", re.DOTALL)

#: A word of small letters of ASCII and Latin-1: no normaliser changes it and no pattern splits it, so the model alone can encode it.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

#: The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the code points from 256 on, in order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}

def _tokenizer(file: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


class WordEncoder:
    """Encodes texts word by word with the tokenizers library, for vocabularies that ignore case and drop white space.

    Their patterns never cross ASCII white space, so a text's ids are the ids of the words between it, in lower-case
    A-Z, one after another. Frequent words are encoded once, plain words by the model alone: the cache is bounded, and what it lacks is encoded anew.
    The vocabulary's special strings inside a text give their own ids, as the library does by default.
    """

    def __init__(self, file: str, cache_words: int = 1_000_000):
        self.tokenizer, self.whole = _tokenizer(file), _tokenizer(file)
        self.tokenizer.encode_special_tokens = True  # words hold no special string; one in other letters is ordinary text
        self.special = [str(t) for t in self.whole.get_added_tokens_decoder().values()]
        self.cache, self.most = {}, cache_words

    def _fresh(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the cache lacks: of the stem and the marks after it, where a pattern always parts the two."""
        split = {w: m.groups() if (m := _STEM.fullmatch(w)) else (w,) for w in words}
        known = {p: self.cache[p] for parts in split.values() for p in parts if p in self.cache}
        lacking = list({p for parts in split.values() for p in parts if p not in known})
        plain = [w for w in lacking if _LETTERS.fullmatch(w)]
        known.update((w, array("I", [t.id for t in self.tokenizer.model.tokenize(w.decode("latin-1").translate(_BYTE_LETTERS))]).tobytes()) for w in plain)
        if len(plain) < len(lacking):
            known.update(self._encoded([w for w in lacking if w not in known]))
        return known | {w: known[parts[0]] + known[parts[1]] for w, parts in split.items() if len(parts) == 2}

    def _encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Words encoded as one text and told apart by where ids begin."""
        texts = [" " + w.decode() for w in words]
        found = self.tokenizer.encode("".join(texts), add_special_tokens=False)
        at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        cut = (4 * np.searchsorted(at, np.concatenate([[0], ends]))).tolist()
        ids = array("I", found.ids).tobytes()
        return {w: ids[a:b] for w, a, b in zip(words, cut, cut[1:], strict=False)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a text with a special string is encoded as it is."""
        special = {i: array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes() for i, text in enumerate(texts) if any(x in text for x in self.special)}
        found = self._by_words([text for i, text in enumerate(texts) if i not in special])
        return [special[i] if i in special else next(found) for i in range(len(texts))]

    def _by_words(self, texts: list[str]) -> Iterator[bytes]:
        get, missing, split, parts = self.cache.get, set(), [], []
        for text in texts:
            split.append(words := text.encode().lower().split())
            parts.append(ids := list(map(get, words)))
            missing.update(compress(words, map(is_, ids, repeat(None))))
        fresh = self._fresh(list(missing)) if missing else {}
        if len(self.cache) < self.most:
            self.cache.update((w, b) for w, b in fresh.items() if len(w) <= 40)
        return iter([b"".join([fresh[w] if b is None else b for w, b in zip(words, ids, strict=True)] if None in ids else ids) for words, ids in zip(split, parts, strict=True)])


class ByteEncoder:
    """Encodes texts with a byte-level vocabulary of the tokenizers library.

    The file's vocabulary, in which an id is also the rank of its merge, goes to tiktoken's encoder with the splitting
    pattern of byte-level vocabularies: the ids are the same (tests hold them against tokenizers over every code point) and come several times as fast.
    The vocabulary's special strings inside a text give their own ids, as the tokenizers library does by default.
    """

    def __init__(self, file: str):
        import public_tokenizers
        import tiktoken

        self.tokenizer = _tokenizer(file)
        letters = {chr(c): b for b, c in _BYTE_LETTERS.items()}
        ranks = {bytes(letters[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.table = {i: token for token, i in ranks.items()}
        self.size = self.tokenizer.get_vocab_size()
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={str(t): i for i, t in self.tokenizer.get_added_tokens_decoder().items()})

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        one = self.ranked.encode
        return [array("I", one(text, allowed_special="all")).tobytes() for text in texts]

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """The same with special strings as ordinary text, for callers that place reserved ids themselves."""
        one = self.ranked.encode_ordinary
        return [array("I", one(text)).tobytes() for text in texts]


def encoder(file: str, kind: type = ByteEncoder):
    """The worker's own encoder for a vocabulary file."""
    return kept(f"{kind.__name__} {file}", lambda: kind(file))


def default_file(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
