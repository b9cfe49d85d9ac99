"""SentencePiece encoding and decoding with a shared-prefix forward pass.

White space becomes a mark; a text is a sequence of marked words, across which no piece reaches. The distinct new words
of a chunk are sorted, which lists a trie depth-first: from one word to the next only the part behind their common prefix
is computed, and what the forward pass found for the prefix is kept.

Two models are known. For *unigram* models the pass is Viterbi's: the best sum of piece scores that ends at each
position. For *BPE* models that search gives wrong pieces (a BPE encoding need not have the best sum), so the pass keeps
what decides there: the last piece of the prefix's own encoding. It is the one piece ending at the position that stands
unmerged next to the last piece before it; whether two pieces stand so is found by merging them once, and remembered.
Both reach back over the same trie of pieces and read the encoding off the last position.

One pass over the texts, without a shuffle. What is remembered is bounded, whatever the corpus.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.llm.chars import chunks
from twinframe.llm.common import in_batches

MARK = "▁"
#: Where the public vocabulary of the queries lies.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Words and pairs of pieces remembered in a worker.
WORDS, PAIRS = 250_000, 300_000
#: Characters of the words remembered.
WORD_CHARS = 1 << 23
#: Characters whose distinct words are sorted together.
TOGETHER = 1 << 20


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all runs, one behind another; each has its ``size`` and begins at its ``begin``."""
    till = np.cumsum(size)
    return np.repeat(begin - till + size, size) + np.arange(till[-1] if len(till) else 0)


class Numbered(dict):
    """Words by number; one that is looked up for the first time gets the next, and joins ``fresh``."""

    def __init__(self, words: list[str] = ()):
        super().__init__(zip(words, range(len(words))))
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Pieces:
    """A vocabulary: pieces, scores, byte pieces, and the kind of model (``bpe`` or ``unigram``)."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], unknown_id: int, kind: str, special: set[int] = frozenset()):
        if kind not in ("bpe", "unigram"):
            raise ValueError(f"unknown kind of model: {kind}")
        self.pieces, self.scores, self.byte_ids, self.unknown_id, self.kind = pieces, scores, byte_ids, unknown_id, kind
        self.bytes_of = {i: b for b, i in byte_ids.items()}
        self.special = set(special) | {unknown_id}
        skip = self.special | set(self.bytes_of)
        # What each id stands for, as bytes: nothing for a special one.
        self.coded = pa.array([b"" if n in self.special else bytes([self.bytes_of[n]]) if n in self.bytes_of else p.encode() for n, p in enumerate(pieces)], pa.binary())
        self.ids = {p: n for n, p in enumerate(pieces) if n not in skip}
        self.low = min((scores[n] for n in self.ids.values()), default=0.0) - 10.0
        self.pairs: dict[int, bool] = {}
        self.forget()
        # A node: the nodes below it by character, and the id of the piece that ends here or -1.
        self.trie: dict[str, list] = {}
        for p, n in self.ids.items():
            if kind == "unigram" or len(p) == 1 or self.merged(p) == [p]:
                below = self.trie
                for c in p:
                    node = below.setdefault(c, [{}, -1])
                    below = node[0]
                node[1] = n
        self.split = re.compile(self._words())
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece reaches over a mark")

    def _words(self) -> str:
        """The pattern of the stretches that pieces stay within: marks begin one, and so does each ASCII sign that no
        piece holds behind another character than its like; a line end that no piece holds is one."""
        inner = {p[n] for p in self.ids for n in range(1, len(p)) if p[n - 1].isalnum()}
        signs = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in inner)
        line = "" if any("\n" in p for p in self.ids) else "\n"
        letter, other = r"[^\W_]", f"(?:(?![{MARK}{line}])[\\W_])"
        rest = f"(?:{letter}+|(?![{MARK}{line}{signs}])[\\W_]{other}*)"
        return f"{MARK}+{other}*{rest}*|{other}+{rest}*|{rest}+" + ("|\n" if line else "")

    def merged(self, text: str) -> list[str]:
        """BPE by merging: the best-scored adjacent pair first, the leftmost of equals, until no pair is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for n in range(len(parts) - 1):
                i = self.ids.get(parts[n] + parts[n + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], n
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stands(self, a: int, b: int) -> bool:
        """Whether two pieces stay apart when their text is encoded."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        left, right = self.pieces[a], self.pieces[b]
        found = self.pairs[a << 32 | b] = self.merged(left + right) == [left, right]
        return found

    def _ids(self, piece: str) -> list[int]:
        n = self.ids.get(piece)
        if n is not None:
            return [n]
        return [i for c in piece for i in self._fallback(c)]

    def _fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown_id]

    def forward(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of each word; ``words`` are sorted and distinct."""
        step = self._bpe_step if self.kind == "bpe" else self._unigram_step
        # For each length of the current prefix: where its last piece starts, the piece (-1: none), its best score, and
        # the trie nodes still open, by start.
        start, last, score, nodes = [0], [-1], [0.0], [[]]
        before = ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del start[shared + 1 :], last[shared + 1 :], score[shared + 1 :], nodes[shared + 1 :]
            step(word, shared, start, last, score, nodes)
            ids: list[int] = []
            end = len(word)
            while end:
                n, s = last[end], start[end]
                if n >= 0:
                    ids.append(n)
                else:
                    ids += reversed(self._fallback(word[s:end]))
                end = s
            ids.reverse()
            yield word, ids
            before = word

    def _bpe_step(self, word: str, shared: int, start: list, last: list, score: list, nodes: list) -> None:
        root, pairs, stands = self.trie, self.pairs, self._stands
        for at in range(shared, len(word)):
            char, living, chosen, piece = word[at], [], at, -1
            # The longest come first; one of them stands.
            for s, below in nodes[at]:
                node = below.get(char)
                if node is None:
                    continue
                below, n = node
                if below:
                    living.append((s, below))
                if n >= 0 and piece < 0:
                    a = last[s]
                    if a < 0:
                        chosen, piece = s, n
                    else:
                        ok = pairs.get(a << 32 | n)
                        if stands(a, n) if ok is None else ok:
                            chosen, piece = s, n
            node = root.get(char)
            if node is not None:
                if node[0]:
                    living.append((at, node[0]))
                if piece < 0:
                    piece = node[1]
            start.append(chosen)
            last.append(piece)
            nodes.append(living)

    def _unigram_step(self, word: str, shared: int, start: list, last: list, score: list, nodes: list) -> None:
        for at in range(shared, len(word)):
            char, living, best = word[at], [], None
            for s, below in [*nodes[at], (at, self.trie)]:
                node = below.get(char)
                if node is None:
                    continue
                living.append((s, node[0]))
                n = node[1]
                if n >= 0 and (best is None or score[s] + self.scores[n] > best[0]):
                    best = (score[s] + self.scores[n], s, n)
            if char not in self.ids and (best is None or score[at] + self.low > best[0]):
                best = (score[at] + self.low, at, -1)
            score.append(best[0])
            start.append(best[1])
            last.append(best[2])
            nodes.append(living)

    def forget(self) -> None:
        """Drops the words remembered. The ids of word n lie in ``pool``, ``size[n]`` of them from ``begin[n]`` on."""
        self.words, self.pool = Numbered(), array("i")
        self.begin = self.size = self.uses = np.zeros(0, np.int64)
        self.held = 0

    def _tidy(self) -> None:
        """Beyond what may be remembered, only words used more than once stay, the most used half at most."""
        if len(self.words) <= WORDS and self.held <= WORD_CHARS:
            return
        least = max(1, int(np.partition(self.uses, -(WORDS // 2))[-(WORDS // 2)])) if len(self.uses) > WORDS // 2 else 1
        stay = self.uses > least
        words = [w for w, s in zip(self.words, stay.tolist()) if s]
        held, pool = sum(map(len, words)), np.frombuffer(self.pool, np.int32)
        begin, size, uses = self.begin[stay], self.size[stay], self.uses[stay]
        self.forget()
        if held <= WORD_CHARS // 2:
            self.words, self.held, self.size, self.uses = Numbered(words), held, size, uses // 2
            self.begin = np.cumsum(size) - size
            self.pool.frombytes(pool[_runs(begin, size)].tobytes())

    def _learn(self) -> None:
        """The ids of the fresh words."""
        words, pool, fresh = self.words, self.pool, self.words.fresh
        plain = sorted(w for w in fresh if not (self.kind == "bpe" and w.startswith(MARK * 2)))
        # Runs of marks share one score, so that order decides: merged outright.
        runs = (w for w in fresh if self.kind == "bpe" and w.startswith(MARK * 2))
        marks = ((w, [i for p in self.merged(w) for i in self._ids(p)]) for w in runs)
        more = len(fresh)
        first, begin, size = len(words) - more, np.zeros(more, np.int64), np.zeros(more, np.int64)
        for w, ids in chain(self.forward(plain), marks):
            n = words[w] - first
            begin[n], size[n] = len(pool), len(ids)
            pool.extend(ids)
        self.begin, self.size = np.concatenate([self.begin, begin]), np.concatenate([self.size, size])
        self.uses = np.concatenate([self.uses, np.zeros(more, np.int64)])
        self.held += sum(map(len, fresh))
        fresh.clear()

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): the ids of all texts, one behind another, and where those of each begin and end."""
        self._tidy()
        split = [self.split.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int32, int(counts.sum()))
        self._learn()
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        size = self.size[numbers]
        ids = np.frombuffer(self.pool, np.int32)[_runs(self.begin[numbers], size)]
        till = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        return till[np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])].astype(np.int32), ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; none for a null or empty one."""
        ends, ids = self.encode_flat(texts)
        return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]

    def decode_flat(self, ends: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The texts of ids as :meth:`encode_flat` gives them."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), self.coded.take(pa.array(ids))), b"")
        # Other pieces are whole characters, so bytes that are text by themselves are text between them, and the reverse.
        # Only what stands for nothing could let two runs of bytes touch.
        apart = self.bytes_of and np.isin(ids, list(self.special)).any()
        try:
            marked = None if apart else joined.cast(pa.string())
        except pa.ArrowInvalid:
            marked = None
        if marked is None:
            marked = pa.array([self._repaired(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.string())
        text = pc.replace_substring(marked, MARK, " ")
        return pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)

    def _repaired(self, ids: np.ndarray) -> str:
        """The marked text of ``ids``, each run of bytes decoded by itself with U+FFFD for what is no text."""
        out, run = [], bytearray()
        for i in ids.tolist():
            b = self.bytes_of.get(i)
            if b is not None:
                run.append(b)
                continue
            out.append(run.decode("utf-8", "replace"))
            run.clear()
            if i not in self.special:
                out.append(self.pieces[i])
        return "".join(out) + run.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: marks become spaces, the leading one goes; bytes that are no text become U+FFFD."""
        return self.decode_flat(np.array([0, len(ids)], np.int32), np.array(ids, np.int32))[0].as_py()


@lru_cache(maxsize=2)
def load(path: str, kind: str | None = None) -> Pieces:
    """The vocabulary of a SentencePiece model file, read once a worker. ``kind``: unless given, the file's own."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    if kind is None:
        # BPE models number their merges; unigram scores are logs of probabilities.
        scored = [p.get_score(i) for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))]
        kind = "bpe" if all(float(s).is_integer() for s in scored) else "unigram"
    return Pieces(
        [p.id_to_piece(i) for i in range(n)],
        [p.get_score(i) for i in range(n)],
        {int(p.id_to_piece(i)[3:5], 16): i for i in range(n) if p.is_byte(i)},
        p.unk_id(),
        kind,
        {i for i in range(n) if p.is_control(i)},
    )


#: No column of a caller is called so.
_TEXT = "\u0001text"


def encode(df: DataFrame, *, keep: list[str], text_col: str = "text", model_path: str = MODEL_PATH, kind: str | None = None, check: bool = True) -> DataFrame:
    """The columns ``keep`` of ``df``, with ids, n_tokens and round_trip (decoding gives the text back; null if ``check`` is off).

    Null and empty texts have no ids and round trip as empty. Texts are encoded whole. A mark character in a text is taken
    for a space, so such a text does not round trip. Columns of the input that are called like the new ones are replaced.
    """
    keep = [c for c in keep if c.lower() not in ("ids", "n_tokens", "round_trip")]
    rows = in_batches(df).select(*[F.col(c) for c in keep], F.col(text_col).alias(_TEXT))
    schema = T.StructType(rows.schema.fields[:-1]).add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.IntegerType()).add("round_trip", T.BooleanType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path, kind)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for s in chunks(texts, TOGETHER):
                ends, ids = pieces.encode_flat(texts[s])
                *columns, text = [c.slice(s.start, s.stop - s.start) for c in b.columns]
                same = pc.equal(pieces.decode_flat(ends, ids), pc.fill_null(text, "")) if check else pa.nulls(len(text), pa.bool_())
                columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(np.diff(ends)), same]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", "n_tokens", "round_trip"])
        # The worker lives on; what this task remembered need not.
        pieces.forget()

    return rows.mapInArrow(work, schema)


def decode(df: DataFrame, *, ids_col: str = "ids", text_col: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """``df`` with ``text_col``, the text of the ids (null ids: null); an input column of that name is replaced."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = load(model_path)
        for ids in batches:
            yield ids.map(lambda x: None if x is None else pieces.decode(x))

    return in_batches(df).withColumn(text_col, texts(F.col(ids_col)))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document, and whether they decode to its text."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
