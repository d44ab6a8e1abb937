"""Byte-level BPE encoding and decoding by speculation and verification.

Words are proposed as tokens by greedy longest match, which is cheap and mostly right. A proposal is the true encoding
exactly if every token encodes to itself and every adjacent pair of tokens, encoded on its own, comes back as that
pair. All pairs of a group are tested at once against a table of tested pairs; only words that fail are merged exactly,
again all at once. Texts go through in groups of about a million characters as numpy arrays, so that memory is bounded
by the group, not by the batch.

Defined cases: a null text is the empty text (no ids); a special token's string inside a text becomes its id, as the
tokenizer file says; bytes that are not UTF-8 are read as U+FFFD; repeated rows give equal rows; an empty table gives an
empty result; further columns are kept by :func:`with_tokens` and ignored by :func:`round_trip`. Texts are whole at any
length: those above a million characters are cut where a word surely ends, and a long word is merged with a heap, in
n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The public byte-level pattern, with \s as the White_Space property.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
CACHED_WORDS = 300_000
CACHED_LENGTH = 64
CACHED_IDS = 4_000_000
GROUP_CHARS = 1 << 20
NONE = np.int64(1) << 40


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places ``start, start + 1, ...`` of runs of these starts and sizes, one run after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Numbered(dict):
    """Words to numbers; an unseen word gets the next number and is noted."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str | int] = []
        self.next = 0

    def __missing__(self, word: str | int) -> int:
        self.fresh.append(word)
        self[word] = number = self.next
        self.next += 1
        return number


class BytePairCodec:
    """A tokenizer file's byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = byte_characters()
        raw = lambda token: bytes(byte[c] for c in token)
        names = spec["model"]["vocab"]
        self.ids = {raw(token): k for token, k in names.items()}
        self.longest = max(map(len, self.ids))
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.joins: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.joins[names[left] << 32 | names[right]] = (rank, names[left + right])
        keys, values = np.array([*self.joins, -1], np.int64), np.array([*self.joins.values(), (NONE, 0)], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], values[order, 0]
        self.joined = values[:-1, 1]
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("only plain special tokens are supported")
        self.special = {t["content"]: t["id"] for t in added}
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.words = regex.compile(PATTERN)
        self.word_end = regex.compile(rf"(?<=[^{SPACE}]) ")
        self.token_bytes = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, k in [*self.ids.items(), *((t.encode(), k) for t, k in self.special.items())]:
            self.token_bytes[k] = token
        self.blob = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.byte_sizes = np.array([len(t) for t in self.token_bytes], np.int64)
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.pairs, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self._plant()
        self._forget()

    def _plant(self) -> None:
        """A trie of the tokens: sorted keys ``node << 8 | byte`` with their child nodes, and each node's token or -1."""
        nodes, edges = {b"": 0}, {}
        for token in self.ids:
            for k in range(1, len(token) + 1):
                if token[:k] not in nodes:
                    nodes[token[:k]] = len(nodes)
                    edges[nodes[token[: k - 1]] << 8 | token[k - 1]] = nodes[token[:k]]
        keys, children = np.array([*edges], np.int64), np.array([*edges.values()], np.int64)
        order = np.argsort(keys)
        self.edge_keys, self.edge_nodes = keys[order], children[order]
        self.node_token = np.array([self.ids.get(prefix, -1) for prefix in nodes], np.int64)

    def _forget(self) -> None:
        self.numbers = Numbered()
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)

    # --- encoding -----------------------------------------------------------------------------------------------
    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, at, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while at < n:
            end = min(n, at + longest)
            while (found := ids.get(word[at:end])) is None:
                end -= 1
            out.append(found)
            at = end
        return out

    def _longest_at(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token from each place, up to its end, and that token's length."""
        token, length = np.empty(len(at), np.int64), np.zeros(len(at), np.int64)
        node, live, depth = np.zeros(len(at), np.int64), np.arange(len(at)), 0
        while len(live):
            key = node << 8 | data[at[live] + depth]
            edge = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            hit = self.edge_keys[edge] == key
            live, node, depth = live[hit], self.edge_nodes[edge[hit]], depth + 1
            name = self.node_token[node]
            whole = live[name >= 0]
            token[whole], length[whole] = name[name >= 0], depth
            more = at[live] + depth < ends[live]
            live, node = live[more], node[more]
        return token, length

    def propose_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`propose` of many words at once, a token of each in a step: all tokens, and how many each word has."""
        data, lengths = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        at, which = ends - lengths, np.flatnonzero(lengths <= CACHED_LENGTH)
        owners, tokens = [], []
        while len(which):
            token, length = self._longest_at(data, at[which], ends[which])
            owners.append(which)
            tokens.append(token)
            at[which] += length
            which = which[at[which] < ends[which]]
        for k in np.flatnonzero(lengths > CACHED_LENGTH).tolist():
            tokens.append(np.array(self.propose(words[k]), np.int64))
            owners.append(np.full(len(tokens[-1]), k))
        owner = np.concatenate(owners)
        return np.concatenate(tokens)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def merge(self, word: bytes) -> list[int]:
        """Exact merging of one word: the leftmost pair of lowest rank first."""
        tokens: list[int | None] = self.single[np.frombuffer(word, np.uint8)].tolist()
        n, joins = len(tokens), self.joins
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*joins[p], i, p) for i in range(n - 1) if (p := tokens[i] << 32 | tokens[i + 1]) in joins]
        heapq.heapify(heap)
        while heap:
            _, new, i, pair = heapq.heappop(heap)
            j = after[i]
            if tokens[i] is None or j >= n or tokens[i] << 32 | tokens[j] != pair:
                continue
            tokens[i], tokens[j], after[i] = new, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (p := tokens[x] << 32 | tokens[y]) in joins:
                    heapq.heappush(heap, (*joins[p], x, p))
        return [t for t in tokens if t is not None]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once, one pair of each word in a step: all ids, and how many each word has."""
        sizes, which = np.fromiter(map(len, words), np.int64, len(words)), np.arange(len(words))
        tokens = self.single[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.append(self._ranks(tokens[:-1], tokens[1:]), NONE)
        rank[np.cumsum(sizes) - 1] = NONE
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(which):
            low = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            open_ = low < NONE
            rows = np.repeat(open_, sizes)
            done.append((which[~open_], sizes[~open_], tokens[~rows]))
            tokens, rank, sizes, which, low = tokens[rows], rank[rows], sizes[open_], which[open_], low[open_]
            if not len(which):
                break
            places = np.flatnonzero(rank == np.repeat(low, sizes))
            owner = np.searchsorted(np.cumsum(sizes), places, "right")
            at = places[np.append(True, owner[1:] != owner[:-1])]  # the leftmost of each word
            ends = np.cumsum(sizes)
            last = at + 2 >= ends
            tokens[at] = self.joined[low]
            rank[at] = np.where(last, NONE, self._ranks(tokens[at], tokens[np.minimum(at + 2, len(tokens) - 1)]))
            inner = at > ends - sizes
            rank[at[inner] - 1] = self._ranks(tokens[at[inner] - 1], tokens[at[inner]])
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            tokens, rank, sizes = tokens[keep], rank[keep], sizes - 1
        which, sizes, tokens = (np.concatenate([d[k] for d in done]) for k in range(3))
        order = np.argsort(which)
        return tokens[ragged((np.cumsum(sizes) - sizes)[order], sizes[order])], sizes[order]

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`merge_short`, with long words merged one by one."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if max(map(len, words)) <= CACHED_LENGTH:
            return self.merge_short(words)
        short = [w if len(w) <= CACHED_LENGTH else b"x" for w in words]
        flat, sizes = self.merge_short(short)
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        for k, w in enumerate(words):
            if len(w) > CACHED_LENGTH:
                parts[k] = np.array(self.merge(w), np.int64)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        flat, sizes = self.encode_flat(words)
        return [part.tolist() for part in np.split(flat, np.cumsum(sizes)[:-1])]

    def encode_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Speculate on all words, test all adjacent pairs at once, merge those words that fail: ids and sizes."""
        flat, sizes = self.propose_many(words)
        owner = np.repeat(np.arange(len(words)), sizes)
        # a word of one token is that token beside nothing
        within, alone = owner[1:] == owner[:-1], np.flatnonzero(sizes == 1)
        starts = np.cumsum(sizes) - sizes
        keys = np.concatenate(((flat[:-1] << 32 | flat[1:])[within], -1 - flat[starts[alone]]))
        owners = np.concatenate((owner[1:][within], alone))
        distinct, inverse = np.unique(keys, return_inverse=True)
        bad = np.zeros(len(words), bool)
        bad[owners[~self.fitting(distinct)[inverse]]] = True
        failed = np.flatnonzero(bad)
        exact, exact_sizes = self.merge_many([words[k] for k in failed.tolist()])
        # the merged words' ids in place of the guesses
        pool, at = np.concatenate((flat, exact)), starts.copy()
        at[failed], sizes[failed] = len(flat) + np.cumsum(exact_sizes) - exact_sizes, exact_sizes
        return pool[ragged(at, sizes)], sizes

    def fitting(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens (or token alone, as -1 - token) is its own exact encoding; keys are distinct and sorted.

        Tested pairs are kept as sorted arrays, at nine bytes each, until they are too many.
        """
        at = np.searchsorted(self.pairs, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == keys[inside]
        fits = np.empty(len(keys), bool)
        fits[known], unknown = self.pair_fits[at[known]], keys[~known]
        if not len(unknown):
            return fits
        alone = unknown < 0
        left, right = np.where(alone, -1 - unknown, unknown >> 32), unknown & 0xFFFFFFFF
        of = self.token_bytes
        words = [of[a] if single else of[a] + of[b] for a, b, single in zip(left.tolist(), right.tolist(), alone.tolist())]
        flat, sizes = self.merge_many(words)
        first = np.cumsum(sizes) - sizes
        second = np.minimum(first + 1, len(flat) - 1)
        fresh = (flat[first] == left) & np.where(alone, sizes == 1, (sizes == 2) & (flat[second] == right))
        fits[~known] = fresh
        if len(self.pairs) + len(unknown) > 2 * CACHED_WORDS:
            self.pairs, self.pair_fits = keys, fits
        else:
            places = at[~known]
            self.pairs, self.pair_fits = np.insert(self.pairs, places, unknown), np.insert(self.pair_fits, places, fresh)
        return fits

    def _pieces(self, text: str) -> list[str | int]:
        if not self.special or not any(t in text for t in self.special):
            return self.words.findall(text)
        out: list[str | int] = []
        at = 0
        for m in self.split_special.finditer(text):
            out += self.words.findall(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.words.findall(text[at:])

    def _parts(self, text: str) -> Iterator[str]:
        """The text in parts of about GROUP_CHARS, cut before a space after another character, where no word goes on."""
        at = 0
        while len(text) - at > GROUP_CHARS and (m := self.word_end.search(text, at + GROUP_CHARS)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def _learn(self) -> None:
        """Encode the words that are new in the table of numbers."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if not fresh:
            return
        words = [w.encode() for w in fresh if isinstance(w, str)]
        flat, sizes = self.encode_flat(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(words) < len(fresh):
            parts = iter(np.split(flat, np.cumsum(sizes)[:-1]) if words else ())
            listed = [next(parts) if isinstance(w, str) else np.array([w], np.int64) for w in fresh]
            flat, sizes = np.concatenate(listed), np.fromiter(map(len, listed), np.int64, len(listed))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.flat, self.sizes = np.concatenate((self.flat, flat.astype(np.uint32))), np.concatenate((self.sizes, sizes))
        self.used = np.concatenate((self.used, np.zeros(len(sizes), np.int64)))

    def _tidy(self) -> None:
        """Keep the more frequent half of a full table of words, and no long ones."""
        if len(self.numbers) <= CACHED_WORDS and len(self.flat) <= CACHED_IDS:
            return
        words, used, flat, starts, sizes = list(self.numbers), self.used, self.flat, self.starts, self.sizes
        kept = np.argsort(-used, kind="stable")[: CACHED_WORDS // 2].tolist()
        kept = [k for k in kept if isinstance(words[k], str) and len(words[k]) <= CACHED_LENGTH]
        self._forget()
        for k in kept:
            self.numbers[words[k]]
        self.numbers.fresh = []
        at, self.sizes = starts[kept], sizes[kept]
        self.flat, self.starts = flat[ragged(at, self.sizes)], np.cumsum(self.sizes) - self.sizes
        self.used = used[kept] // 2

    def encode_group(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts as unsigned 32-bit integers, and where each text's begin (one more than there are texts)."""
        number = self.numbers.__getitem__
        parts, counts = [np.zeros(0, np.int64)], [0]
        for text in texts:
            own = [np.fromiter(map(number, p), np.int64, len(p)) for p in map(self._pieces, self._parts(text))]
            parts += own
            counts.append(sum(map(len, own)))
        self._learn()
        numbers = np.concatenate(parts)
        self.used += np.bincount(numbers, minlength=len(self.used))
        sizes = self.sizes[numbers]
        ids = self.flat[ragged(self.starts[numbers], sizes)]
        self._tidy()
        return ids, np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]

    def encode_batch(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, offsets = self.encode_group(texts)
        return [part.astype("<u4").tobytes() for part in np.split(ids, offsets[1:-1])]

    # --- decoding -----------------------------------------------------------------------------------------------
    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids."""
        return next(self.decode_group(np.frombuffer(ids, "<u4"), np.array([0, len(ids) // 4]))).decode()

    def decode_group(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """The bytes of the texts whose ids lie between these offsets, as UTF-8."""
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            out = []
            for at in range(a, b, GROUP_CHARS):
                part = ids[at : min(b, at + GROUP_CHARS)]
                out.append(self.blob[ragged(self.byte_starts[part], self.byte_sizes[part])].tobytes())
            raw = b"".join(out)
            yield raw if _is_utf8(raw) else raw.decode("utf-8", "replace").encode()


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(2)
def codec(path: str) -> BytePairCodec:
    """One codec for each Python worker, which tasks reuse."""
    return BytePairCodec(path)


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    """A column's texts in groups of about GROUP_CHARS characters; null as the empty text."""
    group, size = [], 0
    for t in texts:
        group.append((t.as_py() or b"").decode("utf-8", "replace"))
        size += len(group[-1])
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path), hashlib.sha256
        for batch in batches:
            at = 0
            for group in _groups(batch.column(1)):
                ids, offsets = c.encode_group(group)
                raw = ids.astype("<u4").tobytes()
                ids_sha = [sha(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                decoded = [sha(text).hexdigest() for text in c.decode_group(ids, offsets)]
                arrays = [batch.column(0).slice(at, len(group)), pa.array(np.diff(offsets)), pa.array(ids_sha), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(group)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_tokens(
    docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None
) -> DataFrame:
    """docs with its token ids as array<int> in ``ids_col``, their number in ``n_tokens`` and, if asked for, what they decode to.

    Columns of these names are replaced.
    """
    kept = docs.drop(ids_col, "n_tokens", *([decoded_col] if decoded_col else []))
    names, place = kept.columns, kept.columns.index(text_col)
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    added += [T.StructField(decoded_col, T.StringType())] if decoded_col else []
    fields = [*names, *(f.name for f in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            at = 0
            for group in _groups(batch.column(place).cast(pa.binary())):
                ids, offsets = c.encode_group(group)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
                columns = [batch.column(k).slice(at, len(group)) for k in range(len(names))]
                extra = [pa.array(list(c.decode_group(ids, offsets)), pa.binary()).cast(pa.string())] if decoded_col else []
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(np.diff(offsets)), *extra], names=fields)
                at += len(group)
            pa.default_memory_pool().release_unused()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added]))


def decode_ids(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """tokens with the decoded text in ``text_col``, which is replaced; null ids are no ids."""
    kept = tokens.drop(text_col)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            lists = batch.column(names.index(ids_col))
            ids, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy()
            texts = list(c.decode_group(ids, np.concatenate(([0], np.cumsum(sizes)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, text_col])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(text_col, T.StringType())]))
