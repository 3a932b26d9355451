"""Byte-level BPE: a lazily determinised transducer for encoding, an incremental UTF-8 machine for decoding.

**Encoding.**  In byte-pair encoding every prefix of a text has one encoding, and a token sequence is an encoding exactly when each
adjacent pair is one (``encode(a + b) == [a, b]``).  So the last token of each prefix follows from the last tokens of shorter prefixes, left
to right.  The transducer reads one byte at a time.  A state is what the future still depends on: the token boundaries from which a longer
token may still grow, each with the token before it.  On each byte it names the last token of the prefix; the tokens of the word are those
names followed back from its end.  In a long word the tokens that all live boundaries share are final and are emitted on the way, so
lookahead is bounded by the longest token and :data:`PIECE`.  States and transitions are made when first met and kept, like a lazy DFA; the store is
emptied when it is full.

Words come from the tokenizer's own splitting pattern; a word's tokens are remembered, so a word is run through the transducer once.

**Decoding.**  Tokens are byte strings that may end inside a character.  :class:`Utf8Machine` keeps the state of the unfinished character between
tokens and emits characters as soon as they are whole; bytes that can't belong to UTF-8 become U+FFFD.

Defined results: a null text has null tokens and counts of 0; an empty text has no tokens; a null id stays null; repeated rows get equal
tokens; a text of any length is one streaming run, never cut.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmere.llm import common as C

#: Production vocabulary; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The splitting pattern that goes with it (that of the public GPT-2 tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, of a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


#: Bytes of a word after which its final tokens are emitted; a rank beyond all others.
PIECE, NEVER = 4096, 1 << 62


class Transducer:
    """Bytes of a word in, tokens out.

    A boundary is live while the bytes after it are a proper prefix of a token that may follow the token before it: it is kept as that prefix's node in
    the trie of tokens, and the token before. A state's key is flat, ``(node, token, node, token, ...)``, and ends with the root and the last token
    of the prefix, which is also the state's name in ``label``. Earlier tokens aren't in it: they decide nothing that comes, and with them
    there would be many times the states.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = 160_000):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.most_states = most_states
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int]] = {}
        # the trie: node * 256 + byte -> node; the token that ends at a node, or -1; whether it goes on; its bytes; the first of them
        self.trie: dict[int, int] = {}
        self.token_at, self.goes_on, self.depth, self.first_byte = [-1], [True], [0], bytearray(1)
        above = [0]
        for word, token in ranks.items():
            node = 0
            for byte in word:
                self.goes_on[node] = True
                to = self.trie.get(node << 8 | byte)
                if to is None:
                    to = self.trie[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(-1)
                    self.goes_on.append(False)
                    self.depth.append(self.depth[node] + 1)
                    self.first_byte.append(word[0])
                    above.append(node)
                node = to
            self.token_at[node] = token
        # of each token: its bytes, the last of them, the merges that its first and its last byte go into; a token that merging never makes goes into none
        size = max(ranks.values(), default=-1) + 1
        self.size, self.last_byte, first_join, self.last_join = [0] * size, bytearray(size), [NEVER] * size, [NEVER] * size
        for token, word in sorted(self.bytes_of.items()):
            self.size[token], self.last_byte[token] = len(word), word[-1]
            a, b = self.halves(token)
            if a != token:
                first_join[token] = first_join[a] if len(self.bytes_of[a]) > 1 else token
                self.last_join[token] = self.last_join[b] if len(self.bytes_of[b]) > 1 else token
        # the earliest merge of the first byte in any token that goes on from a node; a node comes after the one above it
        self.low = [NEVER] * len(above)
        for node in range(len(above) - 1, 0, -1):
            token = self.token_at[node]
            self.low[above[node]] = min(self.low[above[node]], self.low[node], first_join[token] if token >= 0 else NEVER)
        # the merge of two bytes
        self.border = [NEVER] * (1 << 16)
        for word, token in ranks.items():
            if len(word) == 2:
                self.border[word[0] << 8 | word[1]] = token
        self.reset()

    def reset(self) -> None:
        self.keys: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        # state * 256 + byte -> state
        self.moves: dict[int, int] = {}
        self.label: list[int] = []
        self._add((0, -1))

    def _add(self, key: tuple[int, ...]) -> int:
        self.ids[key] = len(self.keys)
        self.keys.append(key)
        self.label.append(key[-1] if key and key[-2] == 0 else -1)
        return len(self.keys) - 1

    def merge(self, word: bytes) -> list[int]:
        """Plain byte-pair merging by rank, leftmost first; used once a token, to see which merge makes it."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            self.last_merge = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes a token; a byte, or a token that merging never makes, is its own two halves."""
        got = self.split.get(token)
        if got is None:
            word = self.bytes_of[token]
            if len(word) > 1 and self.merge(word) == [token]:
                got = self.ranks[self.last_merge[0]], self.ranks[self.last_merge[1]]
            else:
                got = token, token
            self.split[token] = got
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: no merge across the border comes before the merges that made the pieces beside it.

        Both sides are taken apart, the later merge first, down to the bytes at the border; a merge across any pair of pieces that ranks below
        the merge just undone would have come first.
        """
        if a < 0:
            return len(self.bytes_of[b]) == 1 or self.halves(b)[0] != b
        got = self.pairs.get(a << 32 | b)
        if got is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            got = self.pairs[a << 32 | b] = self._fits(a, b)
        return got

    def _fits(self, a: int, b: int) -> bool:
        ranks, bytes_of = self.ranks, self.bytes_of
        if (len(bytes_of[a]) > 1 and self.halves(a)[0] == a) or (len(bytes_of[b]) > 1 and self.halves(b)[0] == b):
            return False
        bound = 1 << 62
        while True:
            r = ranks.get(bytes_of[a] + bytes_of[b])
            if r is not None and r < bound:
                return False
            whole_a, whole_b = len(bytes_of[a]) == 1, len(bytes_of[b]) == 1
            if whole_a and whole_b:
                return True
            # of equal ranks the left one is merged first, so it is undone last
            if whole_b or (not whole_a and a > b):
                bound, a = a, self.split[a][1] if a in self.split else self.halves(a)[1]
            else:
                bound, b = b + 1, self.split[b][0] if b in self.split else self.halves(b)[0]

    def step(self, state: int, byte: int) -> int:
        """Make the transition of a state on a byte.

        A boundary is dropped when the bytes beside it merge across it before the byte on either side goes into any other merge: then
        no token that goes on from there fits.
        """
        key = self.keys[state]
        trie, token_at, goes_on, low, last_join = self.trie, self.token_at, self.goes_on, self.low, self.last_join
        found, live = -1, []
        for node, before in zip(key[::2], key[1::2], strict=True):
            node = trie.get(node << 8 | byte)
            if node is None:
                continue
            if found < 0:
                token = token_at[node]
                if token >= 0 and self.fits(before, token):
                    found = token
            if goes_on[node]:
                # of equal ranks the left one is merged first
                if before < 0 or low[node] < (across := self.border[self.last_byte[before] << 8 | self.first_byte[node]]) or last_join[before] <= across:
                    live += (node, before)
        key = (*live, 0, found) if found >= 0 else tuple(live)
        to = self.ids.get(key)
        if to is None:
            to = self._add(key)
        self.moves[state << 8 | byte] = to
        return to

    def back(self, ends: list[int], at: int) -> list[int]:
        """The tokens of the first ``at`` bytes, by the last token of each prefix."""
        out, size = [], self.size
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= size[token]
        out.reverse()
        return out

    def shared(self, ends: list[int], state: int) -> int:
        """The last boundary that the tokens before every live boundary have in common."""
        live = {len(ends) - self.depth[node] for node in self.keys[state][::2]}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(last - self.size[ends[last - 1]])
        return live.pop()

    def encode(self, word: bytes) -> list[int]:
        if len(self.keys) > self.most_states:
            self.reset()
        # ends: the last token of each prefix, from the last byte whose token is emitted
        state, out, ends, moves, label = 0, [], [], self.moves, self.label
        for start in range(0, len(word), PIECE):
            if start:
                if not self.keys[state]:
                    break
                at = self.shared(ends, state)
                out += self.back(ends, at)
                del ends[:at]
            for byte in word[start : start + PIECE]:
                to = moves.get(state << 8 | byte)
                if to is None:
                    if len(self.keys) > 2 * self.most_states:  # one endless word: keep this state, forget the rest
                        here = self.keys[state]
                        self.reset()
                        moves, label = self.moves, self.label
                        state = self.ids[here] if here in self.ids else self._add(here)
                    to = self.step(state, byte)
                state = to
                ends.append(label[to])
        if ends and ends[-1] < 0:  # only with a vocabulary whose tokens don't come from merges in the order of ranks
            return self.merge(word)
        return out + self.back(ends, len(ends))


class Words(dict):
    """Word -> its tokens as packed int32, made when first asked for; two generations, the older is forgotten.

    A generation has as many words as fit a hash table of 2^19 places; with one more it would be twice as large.
    """

    def __init__(self, transducer: Transducer, most: int = (1 << 20) // 3):
        super().__init__()
        self.transducer, self.most, self.old = transducer, most, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            tokens = self.transducer.encode(word.encode("utf-8", "replace"))
            got = pack(f"{len(tokens)}i", *tokens)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = {}  # gone before the copy is made
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


# UTF-8 by state: how many continuation bytes are due, and between which bounds the next one must lie
class Utf8Machine:
    """Incremental UTF-8: feed byte strings, get the characters that are whole; invalid bytes give U+FFFD as in the standard's recommended practice."""

    def __init__(self):
        self.due, self.low, self.high, self.kept = 0, 0x80, 0xBF, b""

    def feed(self, data: bytes) -> str:
        if not self.due and data.isascii():
            return data.decode("ascii")
        out: list[str] = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.kept += bytes((b,))
                    self.due -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.due:
                        out.append(self.character(self.kept))
                        self.kept = b""
                    continue
                out.append("�")
                self.due, self.low, self.high, self.kept = 0, 0x80, 0xBF, b""
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.due = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                self.kept = bytes((b,))
            else:
                out.append("�")
        return "".join(out)

    @staticmethod
    def character(b: bytes) -> str:
        code = b[0] & (0x1F if len(b) == 2 else 0x0F if len(b) == 3 else 0x07)
        for c in b[1:]:
            code = code << 6 | c & 0x3F
        return chr(code)

    def end(self) -> str:
        left, self.due, self.kept = self.due, 0, b""
        self.low, self.high = 0x80, 0xBF
        return "�" if left else ""


class Codec:
    """Encoder and decoder of one vocabulary and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.split = regex.compile(pattern).findall
        self.words = Words(Transducer(ranks))
        size = max(ranks.values()) + 1
        self.token_bytes = [b""] * size
        self.whole: list[str] = [""] * size
        self.partial = np.zeros(size, bool)
        for t, i in ranks.items():
            self.token_bytes[i] = t
            try:
                self.whole[i] = t.decode("utf-8")
            except UnicodeDecodeError:
                self.partial[i] = True

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.split(text))), np.int32)

    def decode(self, tokens: np.ndarray) -> str:
        """Streaming decode: whole tokens go through at once while no character is unfinished."""
        out, machine, start = [], Utf8Machine(), 0
        table = self.whole.__getitem__
        for at in np.flatnonzero(self.partial[tokens]).tolist():
            if at < start:
                continue
            out.append("".join(map(table, tokens[start:at].tolist())))
            start = at
            while start < len(tokens):
                out.append(machine.feed(self.token_bytes[tokens[start]]))
                start += 1
                if not machine.due:
                    break
        out.append("".join(map(table, tokens[start:].tolist())))
        out.append(machine.end())
        return "".join(out)


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(key: str, ranks: Callable[[], dict[bytes, int]], pattern: str) -> Codec:
    """One codec a process and vocabulary, so that states and words outlive tasks; ``ranks`` is asked only if there is none yet."""
    got = _CODECS.get((key, pattern))
    if got is None:
        got = _CODECS[key, pattern] = Codec(ranks(), pattern)
        # the stores hold no cycles; the collector needn't walk them again and again
        gc.freeze()
        gc.set_threshold(100_000, 50, 1000)
    return got


@lru_cache(4)
def _vocabulary(path: str) -> tuple[str, dict[bytes, int]]:
    with open(path, "rb") as f:
        key = hashlib.sha256(f.read()).hexdigest()
    return key, read_ranks(path)


def encode_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, n_tokens, tokens, round_trip) of every document, and the columns ``carry`` as they are; round_trip: decoding the tokens gave the text again."""
    spark = docs.sparkSession
    C.settle(spark)
    key, ranks = _vocabulary(vocabulary)
    sent = spark.sparkContext.broadcast(ranks)  # a vocabulary: its size doesn't depend on the data
    rows = C.pick(docs, k=id_column, t=text_column, **{f"x{i}": c for i, c in enumerate(carry)})
    kind = rows.schema["k"].dataType.simpleString()
    carried = "".join(f", `{c}` {rows.schema[f'x{i}'].dataType.simpleString()}" for i, c in enumerate(carry))

    def encoded(own: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, sizes, values, good = batch.column(1), [], [], []
        size = np.zeros(len(texts), np.int64)
        for i in range(len(texts)):
            text = texts[i].as_py()
            if text is None:
                sizes.append(0)
                good.append(None)
                continue
            tokens = own.encode(text)
            size[i] = len(text) if text.isascii() else len(text.encode())
            sizes.append(len(tokens))
            values.append(tokens)
            good.append(own.decode(tokens) == text)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = pa.array(np.concatenate(values) if values else np.zeros(0, np.int32))
        mask = None if not texts.null_count else pa.array([x is None for x in good])
        tokens = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=mask)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(np.array(sizes, np.int64)), tokens, pa.array(good, pa.bool_()), *batch.columns[2:]], names=[id_column, "n_bytes", "n_tokens", "tokens", "round_trip", *carry])

    def run(batches):
        own = codec(key, lambda: sent.value, pattern)
        # what a batch is made of ends with the call, before the next one is read
        for batch in batches:
            yield encoded(own, batch)

    return rows.mapInArrow(C.lean(run), f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint, tokens array<int>, round_trip boolean{carried}")
