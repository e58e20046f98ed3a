"""Byte-level BPE as a deterministic automaton, compiled from the merge list.

A token sequence is the encoding of its text exactly if every adjacent pair of tokens is an
arc of the *token automaton*: states are tokens (plus a start), arcs carry the next token.
The automaton grows by one gadget per merge ``(a, b) -> c``, taken in rank order:

* the state of ``c`` starts as a copy of the state of ``b``, as it is just then;
* every state with an arc ``a`` gets an arc ``c`` beside it (after the removal below, so that
  ``aa`` is taken from the left);
* the arc ``b`` leaves the state of ``a``.

Written out, the automaton would have some 10^9 arcs. It is kept factored instead: each token
stores the gadget that made it (its two parts and its rank), and an arc is looked up by
walking back through the gadgets until one removed it or only bytes are left. The second
table is the byte automaton over the vocabulary: one transition per byte gives the longest
token that ends there, and a link from each token to its longest proper suffix token.

Encoding a pre-split word is then one transition per byte: of the tokens ending at a position
exactly one has an arc from the token in force where it begins. That token is stored, and the
encoding is read off backwards. All words of a batch advance together, position by position,
on NumPy tables. Decoding emits the arc labels (the bytes of each token).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Fixed value: the split pattern that belongs to the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the white space of that pattern, without the plain space.
WHITE = [chr(c) for c in (9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Words longer than this many bytes are encoded one by one; shorter ones side by side.
SIDE_BY_SIDE = 192
#: Distinct words that a worker remembers before it starts over (a memory bound, not a result bound).
REMEMBERED = 400_000
#: Characters that are split at once.
SLICE = 2_000_000


def _byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies spell bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    spare = (b for b in range(256) if b not in set(plain))
    letters.update({chr(256 + i): b for i, b in enumerate(spare)})
    return letters


def read_merges(path: str) -> dict:
    """The vocabulary file as plain tables: spelling of each id and merges as id triples."""
    with open(path.removeprefix("file://"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_letters()
    vocab = {t: i for t, i in model["vocab"].items() if all(c in letters for c in t)}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    triples = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges if a in vocab and b in vocab and a + b in vocab]
    reachable = {c for _, _, c in triples} | {i for t, i in vocab.items() if len(t) == 1}
    spelled = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if i in reachable}
    return {"spelled": spelled, "merges": triples}


#: Slots of the table of transitions between tokens (9 bytes each): a fixed size, whatever is encoded.
ARC_SLOTS = 1 << 21
_SPREAD, _SHIFT = 0x9E3779B97F4A7C15, 64 - 21


class Automaton:
    """The compiled tables; see the module's text."""

    def __init__(self, spelled: dict[int, bytes], merges: list[tuple[int, int, int]]):
        size = max(spelled) + 1
        self.size = size
        self.spelled = spelled
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.born = np.full(size, -1, np.int64)  # rank of the gadget that made the token
        removed: dict[int, int] = {}
        for rank, (a, b, c) in enumerate(merges):
            if self.born[c] >= 0:  # a second way to the same token never fires before the first
                removed.setdefault(a * size + b, rank)
                continue
            self.left[c], self.right[c], self.born[c] = a, b, rank
            removed.setdefault(a * size + b, rank)
        keys = np.fromiter(removed, np.int64, len(removed))
        order = np.argsort(keys)
        self._keys = keys[order]
        self._ranks = np.fromiter(removed.values(), np.int64, len(removed))[order]
        self._removed = removed
        # transitions met so far, by a hash of the pair: a pair and its verdict a slot, the later takes the slot
        self._slot_pair = np.full(ARC_SLOTS, -1, np.int64)
        self._slot_open = np.zeros(ARC_SLOTS, bool)
        self._compile_bytes()

    def _compile_bytes(self) -> None:
        children: list[dict[int, int]] = [{}]
        token_at = [-1]
        of_node: dict[int, int] = {}
        for token, text in self.spelled.items():
            node = 0
            for b in text:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    token_at.append(-1)
                node = nxt
            token_at[node] = token
            of_node[token] = node
        n = len(children)
        goto = np.zeros((n, 256), np.int32)
        fail = np.zeros(n, np.int32)
        longest = np.array(token_at, np.int32)
        for b, child in children[0].items():
            goto[0, b] = child
        level = list(children[0].values())
        while level:
            following: list[int] = []
            for node in level:
                f = fail[node]
                if longest[node] < 0:
                    longest[node] = longest[f]
                row = goto[f].copy()
                for b, child in children[node].items():
                    fail[child] = row[b]
                    row[b] = child
                    following.append(child)
                goto[node] = row
            level = following
        self.goto, self.longest = goto, longest
        self.suffix = np.full(self.size, -1, np.int32)
        for token, node in of_node.items():
            if node:
                self.suffix[token] = longest[fail[node]] if fail[node] else -1
        self.length = np.zeros(self.size, np.int32)
        for token, text in self.spelled.items():
            self.length[token] = len(text)

    # -- arcs of the token automaton ---------------------------------------------------------
    def arc(self, u: int, v: int) -> bool:
        """Whether ``v`` may follow ``u``."""
        pair = u * self.size + v
        slot = pair * _SPREAD % (1 << 64) >> _SHIFT
        if self._slot_pair[slot] == pair:
            return bool(self._slot_open[slot])
        x, y, until, found = u, v, 1 << 60, True
        while True:
            gone = self._removed.get(x * self.size + y)
            if gone is not None and gone < until:
                found = False
                break
            bx, by = int(self.born[x]), int(self.born[y])
            if bx < 0 and by < 0:
                break
            if x == y:  # both parts meet before the gadget that makes them
                until, x, y = bx, int(self.right[x]), int(self.left[y])
            elif bx > by:
                until, x = bx, int(self.right[x])
            else:
                until, y = by + 1, int(self.left[y])
        self._slot_pair[slot], self._slot_open[slot] = pair, found
        return found

    def arcs(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """``arc`` for many pairs at once: read off the table, and worked out for pairs that it lacks."""
        asked = u.astype(np.int64) * self.size + v
        slot = ((asked.astype(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(_SHIFT)).astype(np.int64)
        verdict = self._slot_open[slot]
        unknown = np.flatnonzero(self._slot_pair[slot] != asked)
        if len(unknown):
            pairs, at, back = np.unique(asked[unknown], return_index=True, return_inverse=True)
            found = self._walk(pairs)
            verdict[unknown] = found[back]
            fresh = slot[unknown[at]]
            self._slot_pair[fresh], self._slot_open[fresh] = pairs, found
        return verdict

    def _walk(self, pairs: np.ndarray) -> np.ndarray:
        """The verdict on each distinct pair, by going back through the gadgets that made its tokens."""
        found = np.ones(len(pairs), bool)
        x, y = pairs // self.size, pairs % self.size
        until = np.full(len(pairs), 1 << 60, np.int64)
        open_ = np.arange(len(pairs))
        while len(open_):
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            gone = (self._keys[at] == key) & (self._ranks[at] < until) if len(self._keys) else np.zeros(len(key), bool)
            found[open_[gone]] = False
            bx, by = self.born[x], self.born[y]
            keep = ~gone & ((bx >= 0) | (by >= 0))
            open_, x, y, bx, by, until = open_[keep], x[keep], y[keep], bx[keep], by[keep], until[keep]
            same, first = x == y, bx > by
            until = np.where(same | first, bx, by + 1)
            x, y = np.where(same | first, self.right[x], x), np.where(first & ~same, y, self.left[y])
        return found

    # -- encoding ----------------------------------------------------------------------------
    def encode_word(self, word: bytes) -> list[int]:
        """One word, byte by byte."""
        goto, longest, suffix, length = self.goto, self.longest, self.suffix, self.length
        state, last = 0, [-1] * len(word)
        for i, b in enumerate(word):
            state = int(goto[state, b])
            token = int(longest[state])
            while True:
                start = i + 1 - int(length[token])
                if start == 0 or self.arc(last[start - 1], token):
                    break
                token = int(suffix[token])
            last[i] = token
        out, i = [], len(word)
        while i:
            out.append(last[i - 1])
            i -= int(length[last[i - 1]])
        return out[::-1]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words: ids one after another, and the number of ids of each word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        pieces: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        short = np.flatnonzero(sizes <= SIDE_BY_SIDE)
        # long words side by side too, as long as there are enough of about a size to pay for the steps
        long_ = np.flatnonzero(sizes > SIDE_BY_SIDE)
        long_ = long_[np.argsort(-sizes[long_], kind="stable")]
        while len(long_):
            rows = min(len(long_), max(1, 4_000_000 // int(sizes[long_[0]])))
            part, long_ = long_[:rows], long_[rows:]
            if rows >= 32 and 2 * sizes[part[rows // 2]] > sizes[part[0]]:
                for k, ids in zip(part, self._together([words[k] for k in part], sizes[part])):
                    pieces[k] = ids
            else:
                for k in part:
                    pieces[k] = np.array(self.encode_word(words[k]), np.int32)
        order = short[np.argsort(-sizes[short], kind="stable")]
        for lo in range(0, len(order), 20_000):
            part = order[lo : lo + 20_000]
            for k, ids in zip(part, self._together([words[k] for k in part], sizes[part])):
                pieces[k] = ids
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return (np.concatenate(pieces) if pieces else np.empty(0, np.int32)), counts

    def _together(self, words: list[bytes], sizes: np.ndarray) -> Iterator[np.ndarray]:
        width = int(sizes[0]) if len(sizes) else 0
        text = np.zeros((len(words), width), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        text[np.arange(width)[None, :] < sizes[:, None]] = flat
        last = np.full((len(words), width), -1, np.int32)
        state = np.zeros(len(words), np.int32)
        for i in range(width):
            n = int(np.searchsorted(-sizes, -i, side="left"))  # words longer than i come first
            state[:n] = self.goto[state[:n], text[:n, i]]
            token = self.longest[state[:n]].copy()
            todo = np.arange(n)
            while len(todo):
                start = i + 1 - self.length[token[todo]]
                ok = start == 0
                inner = np.flatnonzero(~ok)
                if len(inner):
                    ok[inner] = self.arcs(last[todo[inner], start[inner] - 1], token[todo[inner]])
                todo = todo[~ok]
                token[todo] = self.suffix[token[todo]]
            last[:n, i] = token
        # read the encodings backwards, all words at once
        out = np.full((len(words), width), -1, np.int32)
        at, filled = sizes.copy(), np.zeros(len(words), np.int64)
        rows = np.flatnonzero(at > 0)
        while len(rows):
            token = last[rows, at[rows] - 1]
            out[rows, filled[rows]] = token
            filled[rows] += 1
            at[rows] -= self.length[token]
            rows = rows[at[rows] > 0]
        for k in range(len(words)):
            yield out[k, : filled[k]][::-1].copy()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.spelled[int(i)] for i in ids)


def _no_ids() -> np.ndarray:
    return np.empty(0, np.int64)


class _Seen(dict):
    """Numbers words in order of first sight."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.at = _no_ids()

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class TextEncoder:
    """Encodes texts; remembers the encodings of chunks and words it has met.

    The split pattern never joins a non-space and the space after it, so a text falls into
    chunks at its single spaces; each distinct chunk is split by the pattern once. Where
    spaces stand beside other white space (``_joined``) the chunks would not be independent:
    such a text goes through the pattern as one chunk.
    """

    _WHITE = frozenset(WHITE)

    def _joined(self, text: str) -> bool:
        """Whether a plain space stands between other white space, so that chunks would not be independent."""
        if "   " in text or text.endswith("  "):
            return True
        return any(w + " " in text or "  " + w in text for w in self._WHITE.intersection(text))

    def __init__(self, automaton: Automaton, pattern: str = PATTERN):
        self.automaton = automaton
        self.find = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.words, self.after_space, self.at_start = _Seen(), _Seen(), _Seen()
        self.word_ids, self.word_start, self.word_count = _no_ids(), _no_ids(), _no_ids()
        self.ids, self.start, self.count = _no_ids(), _no_ids(), _no_ids()

    def _learn_words(self) -> None:
        if self.words.new:
            ids, counts = self.automaton.encode_words([w.encode("utf-8", "surrogatepass") for w in self.words.new])
            self.word_start = np.concatenate([self.word_start, np.cumsum(counts) - counts + len(self.word_ids)])
            self.word_ids = np.concatenate([self.word_ids, ids])
            self.word_count = np.concatenate([self.word_count, counts])
            self.words.new.clear()

    def _learn(self, seen: _Seen, prefix: str) -> None:
        """Encode chunks met for the first time; ``seen.at`` maps their numbers to positions."""
        if not seen.new:
            return
        found = [self.find(prefix + chunk) for chunk in seen.new]
        number = self.words.__getitem__
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        of = np.fromiter((number(w) for ws in found for w in ws), np.int64, int(sizes.sum()))
        self._learn_words()
        counts = self.word_count[of]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = self.word_ids[np.arange(ends[-1]) + np.repeat(self.word_start[of] - ends[:-1], counts)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        per_chunk = ends[bounds[1:]] - ends[bounds[:-1]]
        seen.at = np.concatenate([seen.at, np.arange(len(found)) + len(self.start)])
        self.start = np.concatenate([self.start, np.cumsum(per_chunk) - per_chunk + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.count = np.concatenate([self.count, per_chunk])
        seen.new.clear()

    def encode(self, texts: list[str | None], ids_wanted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (empty unless wanted) and the number of ids of each."""
        flat, totals, lo = [], np.zeros(len(texts), np.int64), 0
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars < SLICE):
                chars += len(texts[hi] or "")
                hi += 1
            if len(self.words) + len(self.after_space) + len(self.at_start) > REMEMBERED or len(self.ids) > 8 * SLICE:
                self._forget()
            first, rest = self.at_start.__getitem__, self.after_space.__getitem__
            heads, tails, chunks = [], [], np.zeros(hi - lo, np.int64)
            for k in range(lo, hi):
                text = texts[k]
                if not text:
                    continue
                if self._joined(text):
                    pieces = [text]
                else:
                    pieces = text.split(" ")
                chunks[k - lo] = len(pieces)
                heads.append(first(pieces[0]))
                tails.append(np.fromiter(map(rest, pieces[1:]), np.int64, len(pieces) - 1))
            self._learn(self.at_start, "")
            self._learn(self.after_space, " ")
            if heads:
                bounds = np.concatenate([[0], np.cumsum(chunks)])
                number = np.empty(bounds[-1], np.int64)
                is_head = np.zeros(bounds[-1], bool)
                is_head[bounds[:-1][chunks > 0]] = True
                number[is_head] = self.at_start.at[np.array(heads)]
                number[~is_head] = self.after_space.at[np.concatenate(tails)] if len(number) > len(heads) else 0
                counts = self.count[number]
                ends = np.concatenate([[0], np.cumsum(counts)])
                totals[lo:hi] = ends[bounds[1:]] - ends[bounds[:-1]]
                if ids_wanted:
                    flat.append(self.ids[np.arange(ends[-1]) + np.repeat(self.start[number] - ends[:-1], counts)])
            lo = hi
        return (np.concatenate(flat) if flat else _no_ids()), totals


_encoders: dict[str, TextEncoder] = {}


def _encoder(key: str, tables) -> TextEncoder:
    """One compiled encoder per Python worker and vocabulary."""
    if key not in _encoders:
        t = tables.value
        _encoders.clear()
        _encoders[key] = TextEncoder(Automaton(t["spelled"], t["merges"]))
    return _encoders[key]


def encode_column(
    df: DataFrame, key: str, text: str, tokenizer: str = DEFAULT_TOKENIZER, counts_only: bool = False
) -> DataFrame:
    """``(key, ids)`` – or ``(key, n_tokens)`` – for every row of ``df``, without a shuffle.

    A null and an empty text both give an empty list (0 tokens). Texts are taken whole and as
    they are; special tokens' spellings are ordinary text. Repeated rows stay repeated, a null
    key is kept, an empty table gives an empty result, other columns are ignored. The
    vocabulary is read on the driver from ``tokenizer`` and sent to the workers: its size is
    that of the vocabulary, whatever the corpus.
    """
    spark = df.sparkSession
    tables = spark.sparkContext.broadcast(read_merges(tokenizer))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, tables)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                ids, totals = encoder.encode(part.column(1).to_pylist(), not counts_only)
                if counts_only:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(totals)], ["k", "n_tokens"])
                else:
                    offsets = np.concatenate([[0], np.cumsum(totals)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(0), lists], ["k", "ids"])

    out = f"k {kind}, " + ("n_tokens long" if counts_only else "ids array<int>")
    picked = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return picked.mapInArrow(run, out).withColumnRenamed("k", key)
