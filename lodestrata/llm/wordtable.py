"""Distinct-word table over a public tokenizer file: every distinct word is encoded once, ids go back by position.

A text is cut where the tokenizer can't join across (see ``CUTS``), so the ids of a text are the ids of
its words in order. New words are encoded many at a time, joined by a separator whose own ids are dropped.
A text that holds an added token's string is given to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

from .workers import trim

#: Code points with Unicode's White_Space property.
SPACE = "\t-\r \x85\xa0  -     　"
#: kind -> (words of a text, separator). "byte": a byte-level pre-tokenizer, where one space belongs to the
#: word after it and runs of white space are words. "word": white space is dropped.
CUTS = {
    "byte": (re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"), "\n"),
    "word": (re.compile(f"[^{SPACE}]+"), " "),
}
#: Texts of ASCII and Latin-1 letters are cut finer, at the tokenizer's own pattern for these characters, so that a word
#: has one entry whatever marks stand beside it (and, where the tokenizer lower-cases, whatever its case).
PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*").fullmatch
LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
FINE = {
    "byte": re.compile(f"{SHORT}| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s{LETTERS}0-9]+|\\s+(?!\\S)|\\s+"),
    "word": re.compile(f"[{LETTERS}]+|[0-9]|{SHORT}|[^\\s{LETTERS}0-9]+"),  # the commonest first; at a quote mark the first two don't match
}
#: Words that a table holds at once. It has two halves: a full young one becomes the old one, whose words come back when met
#: again, so that frequent words stay and rare ones go.
TABLE_WORDS = 300_000
JOIN_WORDS = 2000


#: Words of ASCII and Latin letters, which any pair of pattern libraries cuts alike; only these go by ranks.
COMMON = re.compile(r" ?[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+").fullmatch


def _by_ranks(path: str):
    """Encodes a word by a file of the same vocabulary's ranks, at a fraction of the library's cost for a text."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class WordTable:
    def __init__(self, path: str, kind: str, limit: int = TABLE_WORDS, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find, self.separator = CUTS[kind][0].findall, CUTS[kind][1]
        self.fine, self.lower = FINE[kind].findall, kind == "word"
        self.single = FINE[kind].fullmatch if kind == "word" else lambda word: None
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.limit, self.table, self.old = limit, {}, {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None

        self.fast = _by_ranks(ranks) if ranks and kind == "byte" else None
        self.bare = None  # for words of plain texts, which are in lower case and cut already: the same model without what does that
        if kind == "word":
            space = pre_tokenizers.WhitespaceSplit()  # ASCII's marks and letters stand for their bytes, others are mapped to them
            self.bare = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
            self.bare[0].pre_tokenizer = space
            self.bare[1].pre_tokenizer = pre_tokenizers.Sequence([space, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        solid = []
        for w in words:
            if w.isspace():
                self.table[w] = self._whole(w)
            elif self.fast and COMMON(w):
                ids = self.fast(w)
                self.table[w] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                solid.append(w)
        if whole := [w for w in solid if self.single(w)]:
            left = self._learn_single(whole, self.tokenizer)
            known = set(whole) - set(left)
            solid = [w for w in solid if w not in known]
        for at in range(0, len(solid), JOIN_WORDS):
            part = solid[at : at + JOIN_WORDS]
            enc = self.tokenizer.encode(self.separator.join(part), add_special_tokens=False)
            ids = np.array(enc.ids, "<u4")
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + len(self.separator))  # each past its separator
            first = np.fromiter((x[0] for x in enc.offsets), np.int64, len(ids))
            word = np.searchsorted(ends, first, side="right")
            own = first < ends[np.minimum(word, len(part) - 1)] - len(self.separator)
            ids, word = ids[own], word[own]
            bounds = np.searchsorted(word, np.arange(len(part) + 1))
            flat, bounds = ids.tobytes(), (4 * bounds).tolist()
            self.table.update((w, flat[bounds[i] : bounds[i + 1]]) for i, w in enumerate(part))

    def _learn_single(self, words: list[str], tokenizer) -> list[str]:
        """Learns words that are one run of ids each, which ends at an id with the end-of-word mark: no offsets are needed. Returns those of parts where this doesn't hold."""
        left = []
        for at in range(0, len(words), JOIN_WORDS):
            part = words[at : at + JOIN_WORDS]
            ids = np.array(tokenizer.encode_batch_fast([self.separator.join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids])
            if len(ends) != len(part) or ends[-1] + 1 != len(ids):
                left += part
                continue
            flat, cuts = ids.tobytes(), (4 * ends + 4).tolist()
            self.table.update(zip(part, map(flat.__getitem__, map(slice, [0, *cuts], cuts)), strict=False))
        return left

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of each text: words that are new to the table are learnt together, for all texts at hand."""
        if not self.bare:
            return [self.encode(t) for t in texts]
        plain = [bool(t) and bool(PLAIN(t)) and not self.added(t) for t in texts]
        words = [self.fine(t.lower()) if p else [] for t, p in zip(texts, plain, strict=True)]
        met = set().union(*words)
        if 2 * (len(self.table) + len(met)) > self.limit:
            self.old, self.table = self.table, {}
        table, old = self.table, self.old
        new = [w for w in met if w not in table]
        table.update((w, old[w]) for w in new if w in old)
        new = [w for w in new if w not in table]
        left = self._learn_single([w for w in new if w.isascii()], self.bare[0]) + self._learn_single([w for w in new if not w.isascii()], self.bare[1])
        self._learn(left)
        get = table.__getitem__
        out = [b"".join(map(get, own)) for own in words]
        return [own if p else self.encode(t) for t, p, own in zip(texts, plain, out, strict=True)]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; null: none."""
        if not text:
            return b""
        if self.added(text):
            return self._whole(text)
        if PLAIN(text):
            words = self.fine(text.lower() if self.lower else text)
        else:
            words = self.find(text)
        table = self.table
        try:
            return b"".join([table[w] for w in words])
        except KeyError:
            distinct = dict.fromkeys(words)
            if 2 * (len(table) + len(distinct)) > self.limit:
                self.old, self.table = table, {}
                table = self.table
            new = [w for w in distinct if w not in table]
            table.update((w, self.old[w]) for w in new if w in self.old)
            self._learn([w for w in new if w not in table])
            return b"".join([table[w] for w in words])


_TABLES: dict[tuple[str, str, str | None], WordTable] = {}


def word_table(path: str, kind: str, ranks: str | None = None) -> WordTable:
    """This Python worker's table for a tokenizer file (and a file of its ranks); later tasks of the worker go on with it."""
    key = (path, kind, ranks)
    if key not in _TABLES:
        _TABLES[key] = WordTable(path, kind, ranks=ranks)
    return _TABLES[key]


def release() -> None:
    """Drops this worker's tables: a worker outlives its task, and other stages need its memory."""
    _TABLES.clear()
    trim()
