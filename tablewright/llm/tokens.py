"""Token ids of whole texts by a tokenizer of the tokenizers library, most of all a byte-level BPE.

Byte-level BPE never merges across the borders at which its pattern cuts a text: before the last
white space ahead of something visible, and between letters, digits, signs and line ends. A text is the sequence
of pieces between the borders that two bytes suffice to tell. Words repeat, so a worker keeps the ids of pieces that it has met in a
table of fixed size, and asks the library only for those it does not hold; words that begin with a space
are asked for many at once, where the tokenizer's merges cannot reach from one into the next. Pieces are
always compared in full, never by hash alone. The tokenizer's added tokens (such as <|endoftext|>) have their own ids
wherever a text holds them, as in the library's default call. Texts go through in chunks of a megabyte;
a longer text is not cut, and its task holds some ten times its bytes.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

SLOTS = 20  # bits of the table's size
POOL = 3_000_000  # ids that a worker keeps; past that it starts afresh
CHUNK = 1 << 20  # bytes of text cut into pieces at once
WIDE = 24  # bytes of the pieces that the table holds; longer ones are asked for each time
JOINED = 100  # words that the library's model is asked for at once

_loaded: dict[str, Pieces] = {}

#: Bytes behind a space that may belong to white space, and so do not start a piece with it: ASCII's
#: own, and the first bytes of the characters among which Unicode has the rest.
_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """The kind of each byte, and by pairs of kinds whether a border is certain between the two."""
    kind = np.zeros(256, np.uint8)  # 0: no ASCII character, or a rare control character
    for byte in range(128):
        c = chr(byte)
        if byte not in range(28, 32):
            kind[byte] = 1 if c.isalpha() else 2 if c.isdigit() else 5 if c == " " else 6 if c.isspace() else 3
    kind[ord("'")] = 4  # it may start the ending of a word
    border = np.zeros((8, 8), bool)
    for a in (1, 2, 3):
        border[a, [b for b in (1, 2, 3, 4, 5, 6) if b != a]] = True
    border[3, 4] = False
    border[4, [5, 6]] = True
    border[6, [1, 2, 3, 4]] = True
    return kind, border.ravel()


_KIND, _BORDER = (table.astype(np.uint8).tobytes().ljust(256, b"\0") for table in _kinds())  # for bytes.translate


def _cuttable(file: dict) -> bool:
    """Whether the borders above hold for a tokenizer's file: a byte-level BPE that changes no text before,
    adds no space, cuts by the byte-level pattern and marks no ends of words."""
    cut, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    marks = ("continuing_subword_prefix", "end_of_word_suffix", "dropout")
    whole = model.get("type") == "BPE" and not any(model.get(m) for m in marks) and not model.get("ignore_merges")
    return bool(plain and whole and not file.get("normalizer") and not file.get("truncation") and not file.get("padding"))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, all others for the letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, hidden = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in shown else hidden))
        hidden += byte not in shown
    return letters


#: A space, if any, and Latin letters, told by their bytes.
_WORD = re.compile(
    rb" ?(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|[\xC4-\xC8][\x80-\xBF]|\xC9[\x80-\x8F])+"
).fullmatch
_WORD_BYTES = [32, *range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]


def _separable(file: dict, letters: str) -> bool:
    """Whether no merge of a byte-level BPE joins the end of a word to the space of the next one, so that
    words that begin with a space have the same ids one after another as each by itself."""
    space, inside = letters[32], {letters[byte] for byte in _WORD_BYTES}
    if not inside.issubset(file["model"]["vocab"]):
        return False
    merges = (m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"])
    return not any(b[0] == space and inside.issuperset(a) and a[-1] != space for a, b in merges)


class Pieces:
    """A tokenizer with the ids of the pieces it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        file = json.loads(self.tokenizer.to_str())
        self.cuttable = _cuttable(file)
        added = {t.content.encode(): (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        added.pop(b"", None)
        longest_first = sorted(added, key=len, reverse=True)
        self.added = regex.compile(b"|".join(map(regex.escape, longest_first))) if added else None
        self.added_ids = {content: i for content, (i, _) in added.items()}
        # Tokens that take blanks along or stand at word ends only are left to the library.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word for _, t in added.values())
        self.letters = "".join(_byte_letters())
        self.model = Tokenizer(self.tokenizer.model)  # the same model on a text as it is
        self.separable = self.cuttable and _separable(file, self.letters)
        if self.separable:  # by id, whether a token begins with a space
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
            self.opens[[i for token, i in vocabulary.items() if token.startswith(self.letters[32])]] = True
        self._forget()

    def _forget(self) -> None:
        size = 1 << SLOTS
        self.keys = [np.zeros(size, np.uint64) for _ in range(WIDE // 8)]
        self.length = np.zeros(size, np.uint8)  # 0: empty
        self.first, self.count = np.zeros(size, np.int64), np.zeros(size, np.int32)
        self.pool, self.used = np.zeros(POOL // 8, "<u4"), 0

    def ask(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each piece where its own begin among them and how many they are."""
        spaced, single, odd = [], [], []
        for at, piece in enumerate(pieces):
            if (piece[0] == 32 and piece[1:].isalpha()) or _WORD(piece):
                (spaced if piece[0] == 32 and self.separable else single).append(at)
            else:
                odd.append(at)
        ids, counts = [], []
        for at in range(0, len(spaced), JOINED):
            ids.append(self._words([pieces[i] for i in spaced[at : at + JOINED]]))
            counts.append(np.diff(np.flatnonzero(self.opens[ids[-1]]), append=len(ids[-1])))
        model = self.tokenizer.model.tokenize
        out = [[t.id for t in model(self._shown(pieces[i]))] for i in single]
        for i in odd:  # one by one: for a batch the library starts threads, which costs more than it saves
            out.append(self.tokenizer.encode_batch_fast([pieces[i].decode()], add_special_tokens=False)[0].ids)
        counts.append(np.fromiter(map(len, out), np.int64, len(out)))
        ids.append(np.fromiter(chain.from_iterable(out), "<u4", int(counts[-1].sum())))
        places, each = np.array(spaced + single + odd, np.int64), np.concatenate(counts)
        first, count = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        first[places], count[places] = np.cumsum(each) - each, each
        return np.concatenate(ids), first, count

    def _shown(self, text: bytes) -> str:
        """Bytes as the letters that stand for them in the vocabulary."""
        return codecs.charmap_decode(text, "strict", self.letters)[0]

    def _words(self, pieces: list[bytes]) -> np.ndarray:
        """The ids of words that each begin with a space, and have no other."""
        shown = self._shown(b"".join(pieces))
        return np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")

    def _keep(self, ids: np.ndarray) -> int:
        """Puts ids into the pool and returns their place."""
        at, end = self.used, self.used + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool), len(ids)), "<u4")))
        self.pool[at:end] = ids
        self.used = end
        return at

    def ids_of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text: added tokens are cut out first, what lies between is text by itself.
        A tokenizer that cuts in other ways gets whole texts."""
        if not self.cuttable:
            whole = self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(e.ids, "<u4") for e in whole]
        if self.added is None or not any(map(self.added.search, texts)):
            return self._ids_between(texts)
        sections: list[bytes] = []
        plan: list[list[int | np.ndarray]] = []  # per text places in `sections`, and ids
        for text in texts:
            parts: list[int | np.ndarray] = []
            if self.plain:
                at = 0
                for found in self.added.finditer(text):
                    parts += [len(sections), np.array([self.added_ids[found.group()]], "<u4")]
                    sections.append(text[at : found.start()])
                    at = found.end()
                parts.append(len(sections))
                sections.append(text[at:])
            elif self.added.search(text):
                whole = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
                parts.append(np.array(whole, "<u4"))
            else:
                parts.append(len(sections))
                sections.append(text)
            plan.append(parts)
        between = self._ids_between(sections)
        return [np.concatenate([between[p] if isinstance(p, int) else p for p in parts]) for parts in plan]

    def _ids_between(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of texts without added tokens."""
        data_bytes = b"".join(texts)
        if not data_bytes:
            return [np.zeros(0, "<u4") for _ in texts]
        if self.used > POOL:
            self._forget()
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        data = np.frombuffer(data_bytes + bytes(WIDE), np.uint8)
        start, length = _cut(data_bytes, data, offsets)
        keys = _keys(data, start, length)
        mixed = length.astype(np.uint64)
        for k in keys:
            mixed = (mixed ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        slot = (mixed >> np.uint64(64 - SLOTS)).astype(np.int64)
        known = self.length[slot] == length
        for held, k in zip(self.keys, keys, strict=True):
            known &= held[slot] == k
        first, count = self.first[slot], self.count[slot].astype(np.int64)
        new = np.flatnonzero(~known)
        if len(new):
            first[new], count[new] = self._learn(
                data_bytes, start[new], length[new], [k[new] for k in keys], mixed[new], slot[new]
            )
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.pool[np.arange(total[-1]) + np.repeat(first - total[:-1], count)]
        cuts = total[np.searchsorted(start, offsets)]
        return [ids[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def _learn(self, data_bytes, start, length, keys, mixed, slot):
        """Places and counts of the ids of pieces that the table does not hold."""
        order = np.argsort(mixed)
        same = np.zeros(len(order), bool)
        same[1:] = length[order][1:] <= WIDE
        for k in (mixed, length, *keys):  # equal hashes with different pieces stay apart
            k = k[order]
            same[1:] &= k[1:] == k[:-1]
        head = order[~same]
        ends = (start + length)[head].tolist()
        ids, first, count = self.ask([data_bytes[a:b] for a, b in zip(start[head].tolist(), ends, strict=True)])
        first += self._keep(ids)
        fits = length[head] <= WIDE
        into = slot[head][fits]
        into, last = np.unique(into, return_index=True)  # one piece to a slot
        kept = head[fits][last]
        for held, k in zip(self.keys, keys, strict=True):
            held[into] = k[kept]
        self.length[into] = length[kept]
        self.first[into], self.count[into] = first[fits][last], count[fits][last]
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(~same) - 1
        return first[kind], count[kind]


def _cut(data_bytes: bytes, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the pieces of texts at `offsets`; `data` goes on behind their end."""
    size = offsets[-1]
    kind = np.frombuffer(data_bytes.translate(_KIND), np.uint8)
    starts = np.zeros(size, bool)
    starts[1:] = np.frombuffer((kind[:-1] << 3 | kind[1:]).tobytes().translate(_BORDER), bool)
    text = np.zeros(size + 1, bool)
    text[offsets] = True
    space = np.flatnonzero(kind >= 5)  # the last of a run stands apart from the rest
    starts[space[~(_BLANK[data[space + 1]] | text[space + 1])]] = True
    start = np.flatnonzero(starts | text[:size])
    return start, np.diff(start, append=size)


def _keys(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """The first bytes of each piece as numbers, eight by eight, zero behind its end."""
    windows = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # at every byte
    keep = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    keys = [windows[start] & keep[np.minimum(length, 8)]]
    for at in range(8, WIDE, 8):
        key = np.zeros(len(start), np.uint64)
        some = np.flatnonzero(length > at)
        key[some] = windows[start[some] + at] & keep[np.minimum(length[some] - at, 8)]
        keys.append(key)
    return keys


def pieces_of(path: str) -> Pieces:
    """The tokenizer of a file, loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text of a binary column; null counts as the empty text."""
    pieces, held, size = pieces_of(path), [], 0
    for text in texts:
        held.append(text.as_py() or b"")
        size += len(held[-1])
        if size >= CHUNK:
            yield from pieces.ids_of(held)
            held, size = [], 0
    yield from pieces.ids_of(held)
