"""Byte-level BPE inside tasks: splitting into pieces, cached ids, prefix token counts.

A text is split by the tokenizer's own pattern into pieces that never merge with
each other, so everything about a text follows from its pieces, and pieces recur.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa

from .arrowtext import release

# Character classes of the split pattern below U+0250 (letters, numbers,
# white space), on which all Unicode versions agree. Texts with other characters are
# split by the tokenizer library itself.
_FAST_END = 0x250
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = " \t\n\r\x0b\x0c\x85\xa0"
_SPACE_STARTS = frozenset(c.encode()[0] for c in _SPACES)
# Endings that the pattern splits off after an apostrophe.
_ENDINGS = ("s", "d", "m", "t", "ll", "ve", "re")
_ENDING_BYTES = {x.encode() for x in _ENDINGS}

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3


def _class_table() -> np.ndarray:
    table = np.full(_FAST_END, _OTHER, np.uint8)
    for pattern, code in ((_LETTERS, _LETTER), (_NUMBERS, _NUMBER), (_SPACES, _SPACE)):
        member = re.compile(f"[{pattern}]")
        table[[c for c in range(_FAST_END) if member.match(chr(c))]] = code
    return table


_CLASSES = _class_table()


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Classes of the two-byte characters, by the eleven bits they hold.
_TWO_BYTE = np.full(2048, _OTHER, np.uint8)
_TWO_BYTE[:_FAST_END] = _CLASSES


def _starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mark the bytes at which pieces start, for texts laid end to end.

    Right for texts whose characters all lie below U+0250 (ASCII and two-byte ones).
    """
    n = len(data)
    kind = _CLASSES[np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    lead = lead[lead + 1 < n]
    kind[lead] = kind[lead + 1] = _TWO_BYTE[(data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63]
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    ends = offsets[1:] - 1
    space = kind == _SPACE
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:]
    before[ends[ends >= 0]] = False  # white space at the end of a text stays whole
    last = np.flatnonzero(before)
    plain = data[last] == 32
    # the last character of white space before a word leaves the run before it ...
    start[last - ((data[last] & 0xC0) == 0x80)] = True
    # ... and a plain space then belongs to the word
    start[last[plain] + 1] = False
    start[offsets] = True
    quotes = np.flatnonzero((data == 39) & start[:n])
    if len(quotes):
        stop = offsets[np.searchsorted(offsets, quotes, side="right")]
        for q, end in zip(quotes.tolist(), stop.tolist()):
            after = data[q + 1: min(q + 3, end)].tobytes()
            for ending in _ENDINGS:
                if after.startswith(ending.encode()):
                    start[q + 1: q + 1 + len(ending)] = False
                    start[q + 1 + len(ending)] = True
                    break
    return start


def spread(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Join the runs ``flat[begin:begin+length]`` in order."""
    total = int(length.sum())
    shift = np.repeat(begin - (np.cumsum(length) - length), length)
    return flat[shift + np.arange(total)]


class Specials:
    """Splits a text around the tokenizer's added special strings, as its default does."""

    def __init__(self, tokenizer):
        self.ids = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.ids, key=len, reverse=True)))) if self.ids else None

    def split(self, text: str) -> list[str]:
        """Ordinary text at even places, special strings at odd ones."""
        if self.pattern is None or not any(s in text for s in self.ids):
            return [text]
        out, at = [], 0
        for m in self.pattern.finditer(text):
            out += [text[at:m.start()], m.group()]
            at = m.end()
        return [*out, text[at:]]


class Pieces:
    """The pieces of texts laid end to end: distinct pieces, and which of them come in what order.

    Texts with characters beyond the fast range or with special strings have no pieces
    here; ``odd`` lists them and the caller handles them one by one.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, specials: Specials):
        beyond = data >= 0xCA
        beyond[:-1] |= (data[:-1] == 0xC9) & (data[1:] >= 0x90)
        places = np.flatnonzero(beyond)
        raw = data.tobytes()
        for s in specials.ids:
            at = raw.find(s.encode())
            while at >= 0:
                places = np.append(places, at)
                at = raw.find(s.encode(), at + 1)
        self.odd = np.unique(np.searchsorted(offsets, places, side="right") - 1)
        start = np.flatnonzero(_starts(data, offsets)[:-1]) if len(data) else np.zeros(0, np.int64)
        owner = np.searchsorted(offsets, start, side="right") - 1
        length = np.diff(np.append(start, len(data)))
        if len(self.odd):
            ours = ~np.isin(owner, self.odd)
            keep = np.repeat(ours, length)
            start, owner, length, raw = start[ours], owner[ours], length[ours], data[keep].tobytes()
        bounds = np.append(0, np.cumsum(length)).astype(np.int64)
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw)])
        coded = array.dictionary_encode()
        self.distinct: list[bytes] = coded.dictionary.to_pylist()
        self.which = coded.indices.to_numpy(zero_copy_only=False)
        self.owner = owner


#: Memory of one entry beside the bytes of its key and value, about.
ENTRY_BYTES = 200
#: Memory of the pieces kept by one encoder or counter: twice this at most, and one batch.
KEPT_BYTES = 64 << 20
#: The same for tasks that share their worker's memory with other stages.
FEW_KEPT_BYTES = 16 << 20


class Recent(dict):
    """A dict that keeps the entries used since it was last full, and those of the time before.

    ``size_of`` gives the bytes of a value. Each of both parts holds about ``most`` bytes at most,
    entries that came back from the old part included.
    """

    def __init__(self, most: int, size_of=len):
        super().__init__()
        self.most, self.size_of, self.old = most, size_of, {}

    def __missing__(self, key):
        value = self.old[key]  # KeyError if it is new
        self[key] = value
        return value

    def get(self, key):
        try:
            return self[key]
        except KeyError:
            return None

    def held(self) -> int:
        """Bytes of the newer part, about: entries weighed by a few of them."""
        some = [len(k) + self.size_of(v) for k, v in islice(self.items(), 0, None, max(1, len(self) // 1000))]
        return int(len(self) * (ENTRY_BYTES + sum(some) / max(len(some), 1)))

    def turn(self) -> None:
        """Call between batches."""
        if len(self) * ENTRY_BYTES > self.most or self.held() > self.most:
            self.old = dict(self)
            self.clear()


@lru_cache(maxsize=2)
def shared(kind: type, path: str, kept_bytes: int = KEPT_BYTES):
    """One encoder or counter for all tasks of a worker process, so what it has learned stays."""
    return kind(path, kept_bytes)


def forgetful(mapper):
    """A mapper after whose tasks the worker keeps no encoder, counter or tokenizer."""

    def run(batches):
        try:
            yield from mapper(batches)
        finally:
            shared.cache_clear()
            release()

    return run


class IdEncoder:
    """Token ids of whole texts.

    Ids of each distinct piece come from the tokenizer library once and are kept;
    the memory of kept pieces is bounded by starting anew beyond ``kept_bytes``.
    """

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        self.tokenizer = load_tokenizer(path)
        self.specials = Specials(self.tokenizer)
        self.kept: Recent = Recent(kept_bytes)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids) of texts laid end to end."""
        self.kept.turn()
        kept, n = self.kept, len(offsets) - 1
        pieces = Pieces(data, offsets, self.specials)
        found = list(map(kept.get, pieces.distinct))
        if new := [k for k, x in enumerate(found) if x is None]:
            texts = [pieces.distinct[k].decode() for k in new]
            for k, enc in zip(new, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                found[k] = kept[pieces.distinct[k]] = array("I", enc.ids).tobytes()
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        length = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        begin = np.cumsum(length) - length
        ids = spread(flat, begin[pieces.which], length[pieces.which])
        sizes = np.bincount(pieces.owner, weights=length[pieces.which], minlength=n).astype(np.int64)
        if len(pieces.odd):
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            texts = [data[offsets[k]:offsets[k + 1]].tobytes().decode() for k in pieces.odd]
            for k, enc in zip(pieces.odd.tolist(), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                parts[k] = np.array(enc.ids, dtype="<u4")
                sizes[k] = len(parts[k])
            ids = np.concatenate(parts).astype("<u4")
        return ids, np.append(0, np.cumsum(sizes))


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins byte-level vocabularies use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixCounter:
    """Exact token counts of every prefix of a text, by dynamic programming.

    The encoding of a prefix ends in the one vocabulary entry that reaches back to a
    shorter prefix and does not interact with that prefix's own last token, so
    ``count[i] = count[i - len(last)] + 1``. Pieces are worked out once and kept.
    """

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        self.tokenizer = load_tokenizer(path)
        self.specials = Specials(self.tokenizer)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = _byte_alphabet()
        as_bytes = {s: bytes(alphabet[c] for c in s) for s in model["vocab"] if all(c in alphabet for c in s)}
        self.vocab = {as_bytes[s]: i for s, i in model["vocab"].items() if s in as_bytes and s not in self.specials.ids}
        self.longest = max(map(len, self.vocab))
        self.made: dict[int, int] = {}  # merge rank that makes a token; base tokens have none
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            ids = model["vocab"][left], model["vocab"][right]
            whole = model["vocab"][left + right]
            self.rank[ids] = r
            self.made.setdefault(whole, r)
            self.halves.setdefault(whole, ids)
        self.fits: dict[tuple[int, int], bool] = {}
        self.kept: Recent = Recent(kept_bytes, lambda steps: len(steps[0]) + 90)

    def _apart(self, left: int, right: int) -> bool:
        """Do both tokens stay as they are when they stand side by side?

        Walks back through the merges that made them, latest first: at no moment may
        the pair at their border have been the better merge.
        """
        limit = len(self.rank) + 1
        while True:
            r = self.rank.get((left, right))
            if r is not None and r < limit:
                return False
            a, b = self.made.get(left, -1), self.made.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.halves[left][1]
            else:  # of equal merges the left one comes first
                limit, right = b + 1, self.halves[right][0]

    def _ends(self, data: bytes) -> list[int]:
        """Token counts of all byte prefixes of one piece, from the empty one on."""
        last, count = [-1], [0]
        vocab, fits, longest = self.vocab, self.fits, self.longest
        for i in range(1, len(data) + 1):
            for j in range(max(0, i - longest), i):
                token = vocab.get(data[j:i])
                if token is None:
                    continue
                if j:
                    pair = (last[j], token)
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = self._apart(*pair)
                    if not ok:
                        continue
                last.append(token)
                count.append(count[j] + 1)
                break
        return count

    def _learn(self, piece: bytes) -> tuple[bytes, int]:
        counts = self._ends(piece)
        if piece[:1] == b"'" and piece[1:] in _ENDING_BYTES:
            counts[1:-1] = range(1, len(piece))  # cut inside, the apostrophe stands alone
        if not piece.isascii():
            counts = [c for c, byte in zip(counts, piece) if byte & 0xC0 != 0x80] + counts[-1:]
        steps = array("h", [y - x for x, y in zip(counts, counts[1:])])
        out = self.kept[piece] = steps.tobytes(), counts[-1]
        return out

    def _get(self, piece: bytes) -> tuple[bytes, int]:
        return self.kept.get(piece) or self._learn(piece)

    def _in_run(self, space: bytes, after: bytes) -> int:
        """The step to the last character of white space that a word takes part of.

        Cut there, the white space is still one piece.
        """
        one = after[:1] if after[0] < 0x80 else after[:2] if after[0] < 0xE0 else after[:3]
        return self._get(space + one)[1] - self._get(space)[1]

    def _odd(self, text: str) -> np.ndarray:
        """Steps of one text by the library's own pieces, without specials."""
        pieces = [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        steps = np.frombuffer(b"".join(self._get(p.encode())[0] for p in pieces), dtype="<i2").copy()
        at = 0
        for p, after in zip(pieces, pieces[1:]):
            at += len(p)
            if p.isspace() and after[0].isspace():
                self._mend(steps, at, len(steps), self._in_run(p.encode(), after.encode()))
        return steps

    @staticmethod
    def _mend(steps: np.ndarray, at: int, end: int, step: int) -> None:
        more = step - int(steps[at])
        steps[at] += more
        if at + 1 < end:
            steps[at + 1] -= more

    def _with_specials(self, text: str) -> np.ndarray:
        parts = self.specials.split(text)
        out = []
        for ordinary, special in zip(parts[::2], [*parts[1::2], ""]):
            if not special:
                out.append(self._odd(ordinary))
                continue
            through = self._odd(ordinary + special[:-1])  # up to its last character it is ordinary text
            whole = int(self._odd(ordinary).astype(np.int64).sum())
            out.append(np.append(through, np.array([whole + 1 - int(through.astype(np.int64).sum())], "<i2")))
        return np.concatenate(out)

    def steps(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(steps, offsets, token counts) of texts laid end to end.

        The running sum of a text's steps gives the token count of its prefixes of
        1, 2, ... code points.
        """
        self.kept.turn()
        if len(self.fits) > 600_000:
            self.fits.clear()
        n = len(offsets) - 1
        pieces = Pieces(data, offsets, self.specials)
        found = [self._get(p) for p in pieces.distinct]
        flat = np.frombuffer(b"".join([x[0] for x in found]), dtype="<i2")
        length = np.fromiter((len(x[0]) for x in found), np.int64, len(found)) >> 1
        count = np.fromiter((x[1] for x in found), np.int64, len(found))
        begin = np.cumsum(length) - length
        which, owner = pieces.which, pieces.owner
        steps = spread(flat, begin[which], length[which])
        sizes = np.bincount(owner, weights=length[which], minlength=n).astype(np.int64)
        tokens = np.bincount(owner, weights=count[which], minlength=n).astype(np.int64)
        ends = np.cumsum(sizes)
        opens = np.array([p[0] in _SPACE_STARTS for p in pieces.distinct], bool)
        space = np.zeros(len(opens), bool)
        for k in np.flatnonzero(opens).tolist():
            first = pieces.distinct[k][:2].decode(errors="ignore")[:1]
            opens[k], space[k] = first.isspace(), pieces.distinct[k].decode().isspace()
        if len(which):
            runs = np.flatnonzero(space[which[:-1]] & opens[which[1:]] & (owner[:-1] == owner[1:]))
            at = np.cumsum(length[which])[runs]
            for k, place in zip(runs.tolist(), at.tolist()):
                step = self._in_run(pieces.distinct[which[k]], pieces.distinct[which[k + 1]])
                self._mend(steps, place, int(ends[owner[k]]), step)
        if len(pieces.odd):
            parts = np.split(steps, ends[:-1])
            for k in pieces.odd.tolist():
                parts[k] = self._with_specials(data[offsets[k]:offsets[k + 1]].tobytes().decode())
                sizes[k], tokens[k] = len(parts[k]), int(parts[k].astype(np.int64).sum())
            steps = np.concatenate(parts).astype("<i2")
        return steps, np.append(0, np.cumsum(sizes)), tokens
