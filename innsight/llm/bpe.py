"""BPE encoding by backtracking over longest token matches, decoding by an offset table.

The vocabulary file is one of the tokenizers library's: its normaliser and word
split decide the words, its merges decide the tokens. A word is encoded without
replaying merges: an Aho-Corasick automaton gives the longest token at each
place; the encoder takes it if it is compatible with the token before it, else
the next shorter one that is a token, else steps back. Two tokens are compatible
when merging their joined text gives exactly the two; a sequence whose
neighbours are all compatible is the merges' result. Places from which no end is
reachable are marked and never tried again, so a word takes time linear in its
length.

Compatibility is found from the ranks at which tokens are formed and kept in a
table; words are kept with their ids. These tables are bounded and only save
time.

Defined cases: a null text counts as empty and has no ids; no ids decode to an
empty text; special tokens written in a text get their own ids; rows repeated
whole give equal results; an empty table gives an empty result; other columns
are kept by ``with_ids`` and ``with_decoded``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from innsight.llm.tables import column, free_name, read_table, releasing, worker_state

CACHED_WORDS = 150_000  # of each of two generations
CACHED_PAIRS = 300_000
SLICE = 512  # rows handled at once
SLICE_BYTES = 4 << 20  # or, where texts are long, so many bytes
END = "Ā"  # stands for the end of a word; bytes are U+0000 to U+00FF
END_SUFFIX = "</w>"

# Fixed value: the word split that the fast path below is equal to.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: other characters need no normalising but lower case, and stay among these classes
_not_plain = re.compile("[^\0-\u017f]").search
_L, _N, _S = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_plain_words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+").findall


def byte_characters() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte, as character -> byte.

    Printable bytes stand for themselves; the others, in order, for U+0100 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def merge_word(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Replay the merges on a word: lowest rank first, leftmost first. Slow; defines the result."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min(
            (ranks[pair] + (i,) for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if pair in ranks),
            default=None,
        )
        if best is None:
            break
        _, made, i = best
        symbols[i : i + 2] = [made]
    return symbols


@dataclass
class Vocabulary:
    """What the workers need of a tokenizer file; built once on the driver."""

    digest: str  # of the file
    normalizer: object  # the library's, of this file
    pre_tokenizer: object
    split: str  # pattern of the word split
    strings: dict[str, int]  # text of bytes (and END) -> id, of the tokens that merging can reach
    formed: dict[int, tuple[int, int, int]]  # id -> (rank, left id, right id) of its last merge
    ranks: dict[tuple[int, int], int]  # pair of ids -> rank of its merge
    shorter: dict[int, int]  # id -> id of the longest token that is a proper prefix
    specials: dict[str, int]
    names: list[str]  # id -> the token as the library writes it

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        given = json.loads(text)
        model = given["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END_SUFFIX or given["decoder"]:
            raise ValueError(f"{path} is no byte-level BPE file with word ends")
        to_byte = byte_characters()
        vocab = model["vocab"]

        def as_bytes(token: str) -> str:
            body = token.removesuffix(END_SUFFIX)
            return "".join(chr(to_byte[c]) for c in body) + (END if body != token else "")

        in_merges, merges = set(), {}
        for rank, (left, right) in enumerate(model["merges"]):
            made = left + right
            in_merges.update((left, right, made))
            merges.setdefault((vocab[left], vocab[right]), (rank, vocab[made]))
        specials = {t["content"]: t["id"] for t in given["added_tokens"]}
        strings = {as_bytes(t): i for t, i in vocab.items() if t not in specials}
        reachable, formed = {}, {}
        for string, i in strings.items():
            symbols = cls.symbols(string, strings)
            if len(symbols) == 1:
                reachable[string] = i
            elif merge_word(symbols, merges) == [i]:
                reachable[string] = i
                formed[i] = cls.last_merge(symbols, merges)
        shorter = {}
        for string, i in reachable.items():
            for k in range(len(string) - 1, 0, -1):
                if string[:k] in reachable:
                    shorter[i] = reachable[string[:k]]
                    break
        names = [""] * (max([*vocab.values(), *specials.values()]) + 1)
        for name, i in [*vocab.items(), *specials.items()]:
            names[i] = name
        ranks = {pair: rank for pair, (rank, _) in merges.items()}
        library = Tokenizer.from_str(text)
        split = given["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        digest = hashlib.sha256(text.encode()).hexdigest()
        return cls(
            digest, library.normalizer, library.pre_tokenizer, split, reachable, formed, ranks, shorter, specials, names
        )

    @staticmethod
    def symbols(string: str, strings: dict[str, int]) -> list[int]:
        """The ids a word starts with: one per byte, the last with the end of the word."""
        ends = string.endswith(END)
        body = string[:-1] if ends else string
        out = [strings[c] for c in body]
        if ends:
            out[-1] = strings[body[-1] + END]
        return out

    @staticmethod
    def last_merge(symbols: list[int], merges: dict) -> tuple[int, int, int]:
        symbols = list(symbols)
        while True:
            rank, made, i = min(
                merges[p] + (i,) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in merges
            )
            if len(symbols) == 2:
                return rank, symbols[0], symbols[1]
            symbols[i : i + 2] = [made]


class _Words(dict):
    """Word -> ids, encoded when asked for first. What was not asked for in two fillings goes."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode((word if word.isascii() else word.encode().decode("latin-1")) + END)
        self[word] = ids
        return ids


_NOTHING = (0, (None, 0))


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for string, i in vocabulary.strings.items():
            self.automaton.add_word(string, (i, len(string)))
        self.automaton.make_automaton()
        self.length = {i: len(s) for s, i in vocabulary.strings.items()}
        self.closing = {i for s, i in vocabulary.strings.items() if s.endswith(END)}
        self.normalizer, self.pre_tokenizer = vocabulary.normalizer, vocabulary.pre_tokenizer
        self.byte_of = byte_characters()
        self.special = (
            re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.specials, key=len, reverse=True))) + ")")
            if vocabulary.specials
            else None
        )
        self.plain = vocabulary.split == WORD_SPLIT
        self.pairs: dict[int, bool] = {}
        self.words = _Words(self.encode_word)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two tokens gives the two tokens.

        Walk back through the merges that formed them, latest first. At each
        state the tokens a and b that touch would merge if their pair's rank
        comes before the merge that ended the state: strictly before on the left
        side (equal pairs merge leftmost first), or not after on the right.
        """
        formed, ranks = self.v.formed, self.v.ranks
        a, b = left, right
        a_ends = b_ends = len(self.v.names) + len(ranks)
        while True:
            rank = ranks.get((a, b))
            if rank is not None and rank < a_ends and rank <= b_ends:
                return False
            made_a, made_b = formed.get(a), formed.get(b)
            if made_a is None and made_b is None:
                return True
            if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
                a_ends, a = made_a[0], made_a[2]
            else:
                b_ends, b = made_b[0], made_b[1]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one word, given as its bytes (U+0000 to U+00FF) and END."""
        whole = self.v.strings.get(word)
        if whole is not None:
            return (whole,)
        longest_match = self.automaton.iter_long
        greedy = [token for _, (token, _) in longest_match(word)]
        pairs, fits = self.pairs, self.fits
        if len(pairs) > CACHED_PAIRS:
            pairs.clear()
        # the longest tokens one after another are right as far as neighbours fit
        good, last = 1, greedy[0]
        for token in greedy[1:]:
            known = pairs.get(last << 20 | token)
            if not (fits(last, token) if known is None else known):
                break
            good, last = good + 1, token
        if good == len(greedy) and last in self.closing:
            return tuple(greedy)
        n = len(word)
        length, shorter = self.length, self.v.shorter
        dead = bytearray(n + 1)
        out = greedy[:good]
        at = sum([length[t] for t in out])
        token = shorter.get(greedy[good]) if good < len(greedy) else None
        while at < n:
            while token is not None:
                to = at + length[token]
                if not dead[to]:
                    if not out:
                        break
                    known = pairs.get(out[-1] << 20 | token)
                    if fits(out[-1], token) if known is None else known:
                        break
                token = shorter.get(token)
            if token is None:  # no way on from here
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter.get(token)
            else:
                out.append(token)
                at = to
                if at < n:
                    _, (token, _) = next(longest_match(word, at), _NOTHING)
        return tuple(out)

    def fits(self, left: int, right: int) -> bool:
        """``compatible``, kept in the pair table."""
        known = self.pairs[left << 20 | right] = self.compatible(left, right)
        return known

    def encode(self, text: str) -> list[int]:
        specials = self.v.specials
        if self.special is None or not any(s in text for s in specials):
            return self._ids(text)
        out: list[int] = []
        for part in self.special.split(text):
            out += [specials[part]] if part in specials else self._ids(part)
        return out

    def _ids(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        if self.plain and (text.isascii() or not _not_plain(text)):
            words = _plain_words(text.lower())
        else:
            split = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
            words = [bytes([self.byte_of[c] for c in word]).decode() for word, _ in split]
        return list(chain.from_iterable(map(self.words.__getitem__, words)))


def _in_worker(shared, make):
    """The worker's object made of a broadcast vocabulary, kept while the same vocabulary is asked for."""
    kept = worker_state(f"bpe_{make.__qualname__}", dict)
    vocabulary = shared.value
    if kept.get("digest") != vocabulary.digest:
        kept.update(digest=vocabulary.digest, made=make(vocabulary))
    return kept["made"]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE rows and about SLICE_BYTES, so that what is made of one batch stays small."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            rows = min(SLICE, batch.num_rows - start)
            while rows > 1 and batch.slice(start, rows).nbytes > SLICE_BYTES:
                rows = (rows + 1) // 2
            yield batch.slice(start, rows)
            start += rows


def _with_columns(df: DataFrame, added: dict[str, T.DataType], make) -> DataFrame:
    """``df`` with columns that ``make`` computes, as a list of arrays, from each slice of its rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, *make(part)], names=[*part.schema.names, *added])

    fields = [T.StructField(name, kind) for name, kind in added.items()]
    return df.mapInArrow(releasing(add), T.StructType([*df.schema.fields, *fields]))


IDS = T.ArrayType(T.IntegerType())


def _encode_array(encoder: Encoder, texts: pa.Array) -> pa.ListArray:
    ids = [np.array(encoder.encode(t.as_py() or ""), dtype=np.int32) for t in texts]
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))


def _decode_array(table: pa.Array, ids: pa.ListArray) -> pa.Array:
    ids = ids.fill_null([]) if ids.null_count else ids
    lists = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), table.take(ids.flatten()))
    return pc.binary_join(lists, " ")


def with_ids(df: DataFrame, path: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """``df`` with the token ids of the text, array<int>. ``path`` is read on the driver only."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    place = df.columns.index(text_col)

    def encode(part: pa.RecordBatch) -> list[pa.Array]:
        return [_encode_array(_in_worker(shared, Encoder), part.column(place))]

    return _with_columns(df, {into: IDS}, encode)


def offset_table(names: list[str]) -> pa.Array:
    """All tokens in one buffer with the offset of each."""
    texts = [n.encode() for n in names]
    offsets = np.cumsum([0, *map(len, texts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(names), pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(texts)))


def with_decoded(df: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids, as the library's decode(ids, skip_special_tokens=False) writes it."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    place = df.columns.index(ids_col)

    def decode(part: pa.RecordBatch) -> list[pa.Array]:
        table = _in_worker(shared, lambda v: offset_table(v.names))
        return [_decode_array(table, part.column(place))]

    return _with_columns(df, {into: T.StringType()}, decode)


def encode_decode(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` and ``decoded`` (names lengthened where taken), both made in one pass."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.read(path))
    place = df.columns.index(text_col)

    def both(part: pa.RecordBatch) -> list[pa.Array]:
        encoder, table = _in_worker(shared, lambda v: (Encoder(v), offset_table(v.names)))
        ids = _encode_array(encoder, part.column(place))
        return [ids, _decode_array(table, ids)]

    return _with_columns(df, {free_name(df, "ids"): IDS, free_name(df, "decoded"): T.StringType()}, both)


def digests(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row, with the ids too if wanted."""
    given = df.select(column(df, id_col).alias(id_col), column(df, text_col).alias("text"))
    both = encode_decode(given, path).drop("text")
    return both.select(
        id_col,
        *["ids"] * keep_ids,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"), vocabulary_path())
