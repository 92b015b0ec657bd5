"""SentencePiece encoding and decoding (operator 10) by vectorised merge rounds.

The vocabulary file of a byte-fallback BPE model is read once per Python worker. Texts are cut where no piece
of the vocabulary can reach across; each distinct word of a task is then encoded once, many words together:

* flat numpy arrays hold one symbol per character and the table entry of each neighbouring pair;
* a segmented minimum finds the best pair rank of every word;
* all leftmost, non-overlapping occurrences of that rank merge at once;
* words without a pair leave the arrays, until none is left.

Merging all occurrences at once equals merging one at a time only while a merge cannot make a pair of the
same or a better rank. ``unsafe`` marks the ranks for which the vocabulary breaks that rule; for those, one
merge is made in a round. Runs of spaces are such a case and have a closed form.
"""

from __future__ import annotations

import functools
import hashlib
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import per_text

SPACE = "▁"
#: Distinct words whose encodings a task keeps; beyond it the table starts anew, which changes no result.
CACHED_WORDS = 600_000
#: Distinct words that are encoded together, so that their arrays stay in a core's cache.
WORDS_TOGETHER = 20_000
NO_PAIR = np.iinfo(np.int32).max


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encoder and decoder for a BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        kind = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "unused" if sp.is_unused(i) else "normal" for i in range(size)]
        piece = [sp.id_to_piece(i) for i in range(size)]
        if "unused" in kind or sp.encode("  a ", out_type=str)[-1] != SPACE or not sp.encode("a", out_type=str)[0].startswith(SPACE):
            raise ValueError(f"{path}: only models with a space prefix, kept spaces and no unused pieces are supported")
        self.size, self.kind = size, kind
        self.byte_id = {int(piece[i][3:5], 16): i for i in range(size) if kind[i] == "byte"}
        if len(self.byte_id) != 256:
            raise ValueError(f"{path}: byte fallback is needed")
        self.unknown_surface = " ⁇ ".encode()
        self.ids = {p: i for i, p in enumerate(piece) if kind[i] == "normal"}
        self.surface = [bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "control" else self.unknown_surface if k == "unknown" else p.replace(SPACE, " ").encode() for p, k in zip(piece, kind)]
        self.decimal = [str(i) for i in range(size)]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"{path}: pieces that span words are not supported")
        joined = set("".join(p for p in self.ids if len(p) > 1))
        self._tables(sp, joined)
        #: Characters in no longer piece never merge, so words can also be cut around a line feed.
        self.cut = re.compile(r" *[^ \n]+|\n| +" if "\n" not in joined else r" *[^ ]+| +")
        self.cache: dict[str, tuple[int, ...]] = {}

    def _tables(self, sp, joined: set[str]) -> None:
        #: Symbols are piece ids; characters that only occur inside longer pieces get ids above the vocabulary.
        self.symbol = dict(self.ids) | {c: self.size + i for i, c in enumerate(sorted(joined - self.ids.keys()))}
        self.extra = {v: k for k, v in self.symbol.items() if v >= self.size}
        scores = {i: sp.get_score(i) for p, i in self.ids.items() if len(p) > 1}
        place = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank_of = {i: place[s] for i, s in scores.items()}
        entries = []
        unsafe = np.zeros(len(place) + 1, bool)
        for p, i in self.ids.items():
            for at in range(1, len(p)):
                a, b = self.symbol.get(p[:at]), self.symbol.get(p[at:])
                if a is not None and b is not None:
                    entries.append((a << 32 | b, rank_of[i], i))
                    for part in (a, b):
                        if part in rank_of and rank_of[part] >= rank_of[i]:
                            unsafe[rank_of[part]] = True
        entries.sort()
        self.pair_key = np.array([e[0] for e in entries] + [np.iinfo(np.int64).max], np.int64)
        self.pair_rank = np.array([e[1] for e in entries] + [NO_PAIR], np.int32)
        self.pair_piece = np.array([e[2] for e in entries] + [-1], np.int32)
        self.unsafe = unsafe
        #: The rank of pieces made of spaces alone, if it is the last rank, theirs alone, and long runs repeat.
        runs = {len(p): i for p, i in self.ids.items() if set(p) == {SPACE}}
        spaces = {rank_of[i] for n, i in runs.items() if n > 1}
        self.longest_run = max(runs)
        self.run_ids, self.run_length = runs, {i: n for n, i in runs.items()}
        self.run_rank = -1
        if spaces == {len(place) - 1} and sum(r in spaces for r in rank_of.values()) == len(runs) - 1:
            most = 3 * self.longest_run
            self.run_parts = [self._merge_run(n) for n in range(most)]
            if all(self.run_parts[n] == [self.longest_run, *self.run_parts[n - self.longest_run]] for n in range(self.longest_run, most)):
                self.run_rank = len(place) - 1
        self.controls = {i for i, k in enumerate(self.kind) if k == "control"}

    def _merge_run(self, n: int) -> list[int]:
        """Lengths of the pieces that leftmost merges make of n spaces."""
        parts = [1] * n
        while (k := next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in self.run_ids), None)) is not None:
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table entry of each pair of symbols; the last entry stands for no piece."""
        key = left.astype(np.int64) << 32 | right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.pair_key, key)
        at[self.pair_key[at] != key] = len(self.pair_key) - 1
        return at

    def _chunk_runs(self, symbols: list[int]) -> list[int]:
        """All merges left in a word whose best pairs are runs of spaces."""
        out: list[int] = []
        run = 0
        for s in [*symbols, None]:
            if n := self.run_length.get(s, 0):
                run += n
                continue
            whole = max(0, run // self.longest_run - 1)
            out += [self.run_ids[n] for n in [self.longest_run] * whole + self.run_parts[run - whole * self.longest_run]]
            run = 0
            if s is not None:
                out.append(s)
        return out

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word (spaces already written as the space symbol), all words in the same rounds."""
        none = len(self.pair_key) - 1
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        distinct, inverse = np.unique(points, return_inverse=True)
        known = np.array([self.symbol.get(chr(c), -1 - int(c)) for c in distinct], np.int32)
        sym = known[inverse] if len(distinct) else np.zeros(0, np.int32)
        sizes = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        entry = np.full(len(sym), none, np.int32)
        at = np.flatnonzero(word[:-1] == word[1:])
        entry[at] = self._pairs(sym[at], sym[at + 1])
        ended: list[tuple[np.ndarray, np.ndarray]] = []  # words and symbols that left the arrays
        by_hand: dict[int, list[int]] = {}
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            rank = self.pair_rank[entry]
            best = np.minimum.reduceat(rank, starts)
            done = (best == NO_PAIR) | (best == self.run_rank)
            if done.any():
                for w in np.flatnonzero(best == self.run_rank):
                    by_hand[int(word[starts[w]])] = self._chunk_runs(sym[starts[w] : starts[w] + sizes[w]].tolist())
                gone = np.repeat(done, sizes)
                ended.append((word[gone], sym[gone]))
                stay = ~gone
                sym, word, entry, rank = sym[stay], word[stay], entry[stay], rank[stay]
                best, sizes = best[~done], sizes[~done]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            new_run = np.r_[True, at[1:] != at[:-1] + 1]
            run_start = at[new_run][np.cumsum(new_run) - 1]
            at = at[(at - run_start) % 2 == 0]
            at = self._safe(at, sym, word, entry)
            sym[at] = self.pair_piece[entry[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            sym, word, entry = sym[keep], word[keep], entry[keep]
            # The pairs on both sides of a merged symbol are new.
            changed = np.concatenate([moved, moved[moved > 0] - 1])
            inner = changed[changed < len(sym) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            entry[changed] = none
            entry[inner] = self._pairs(sym[inner], sym[inner + 1])
        if not ended:
            return [()] * len(words)
        word, sym = np.concatenate([e[0] for e in ended]), np.concatenate([e[1] for e in ended])
        order = np.argsort(word, kind="stable")
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        odd = {*by_hand, *np.unique(word[(sym < 0) | (sym >= self.size)]).tolist()}
        flat = sym[order].tolist()
        out = [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]
        for w in odd:
            out[w] = tuple(self._final(by_hand.get(w, list(out[w]))))
        return out

    def _safe(self, at: np.ndarray, sym: np.ndarray, word: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Of the merges picked for this round, those that come first one by one too.

        A merge may make a pair of the same or a better rank with a neighbour; later merges of its word then wait.
        """
        rank = self.pair_rank[entry[at]]
        if not (risky := self.unsafe[rank]).any():
            return at
        piece = self.pair_piece[entry[at]]
        padded = np.r_[sym, -1, -1, -1]  # at - 1 may be -1, at + 2 the length
        near = np.r_[word, -1, -1, -1]
        hit = np.zeros(len(at), bool)
        last = np.r_[-9, at[:-1]] == at - 2
        for left, right, same in (
            (padded[at - 1], piece, near[at - 1] == word[at]),
            (piece, padded[at + 2], near[at + 2] == word[at]),
            (np.r_[-1, piece[:-1]], piece, last & (near[at - 1] == word[at])),
        ):
            hit |= risky & same & (self.pair_rank[self._pairs(left, right)] <= rank)
        if not hit.any():
            return at
        before = np.cumsum(hit) - hit
        first = np.r_[True, word[at[1:]] != word[at[:-1]]]
        return at[before == before[first][np.cumsum(first) - 1]]

    def _final(self, symbols: list[int]) -> list[int]:
        """Symbols outside the vocabulary become the bytes of their character."""
        if min(symbols) >= 0 and max(symbols) < self.size:
            return symbols
        out: list[int] = []
        for s in symbols:
            if 0 <= s < self.size:
                out.append(s)
            else:
                out += [self.byte_id[b] for b in (self.extra[s] if s >= self.size else chr(-1 - s)).encode()]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, as the library gives them without begin and end ids."""
        cut = [self.cut.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        new = list(set(chain.from_iterable(cut)) - self.cache.keys())
        for k in range(0, len(new), WORDS_TOGETHER):
            part = new[k : k + WORDS_TOGETHER]
            self.cache.update(zip(part, self.encode_words([w.replace(" ", SPACE) for w in part])))
        get = self.cache.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the space prefix goes, byte pieces join into characters, broken ones become U+FFFD."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.kind[i] != "control"), None)
        if first is not None and self.kind[first] == "normal" and self.surface[first].startswith(b" "):
            raw = raw[1:]
        try:
            if self.controls.isdisjoint(ids):
                return raw.decode()
        except UnicodeDecodeError:
            pass
        return self._decode_apart(ids)

    def _decode_apart(self, ids: list[int]) -> str:
        """Each run of byte pieces decoded by itself."""
        out: list[str] = []
        held = b""
        strip = True
        for i in [*ids, None]:
            if i is not None and self.kind[i] == "byte":
                held += self.surface[i]
                continue
            out.append(self._decode_broken(held))
            held = b""
            if i is not None and self.kind[i] != "control":
                text = self.surface[i].decode()
                out.append(text[1:] if strip and self.kind[i] == "normal" and text[:1] == " " and not any(out) else text)
                strip = False
        return "".join(out)

    @staticmethod
    def _decode_broken(raw: bytes) -> str:
        out: list[str] = []
        while raw:
            try:
                out.append(raw.decode())
                break
            except UnicodeDecodeError as e:
                out.append(raw[: e.start].decode() + "�")
                raw = raw[e.start + 1 :]
        return "".join(out)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


ENCODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, n_tokens, ids). A null text is empty and has no ids; other columns of ``docs`` are not read."""
    path = model or default_model()

    def make():
        return lambda texts: [(len(i), i) for i in codec(path).encode(texts)]

    return docs.select(F.col(id_col), per_text(make, ENCODED, 1_000_000)(F.col(text_col)).alias("r")).select(id_col, "r.*")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(id, text) of encoded rows; null ids give an empty text."""
    path = model or default_model()

    @F.pandas_udf("string")
    def text_of(ids):
        one = codec(path)
        return ids.map(lambda x: "" if x is None else one.decode([int(i) for i in x]))

    return encoded.select(F.col(id_col), text_of(F.col(ids_col)).alias("text"))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Encode and decode every text and return digests: (id, n_tokens, ids_sha256, decoded_sha256).

    Rows map one to one, without a shuffle. A null or empty text has no ids and decodes to the empty text.
    Repeated rows repeat; nothing depends on the id, which may be null.
    """
    path = model or default_model()

    def make():
        def work(texts):
            one = codec(path)
            rows = []
            for ids in one.encode(texts):
                digits = ",".join(map(one.decimal.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(digits).hexdigest(), hashlib.sha256(one.decode(ids).encode()).hexdigest()))
            return rows

        return work

    return docs.select(F.col(id_col), per_text(make, DIGESTS)(F.col(text_col)).alias("r")).select(id_col, "r.*")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Token counts and round trip of every whole text of documents."""
    from larder.llm.common import documents

    return round_trip(documents(spark, sf_dir))
