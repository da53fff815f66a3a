"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reports, at each position, the piece found there and, along its output links, every shorter one that ends
there; each report relaxes the best score of that position. A character that no piece covers falls back to its UTF-8
bytes. Blanks stand for the meta symbol; one is put before each text and taken off again by `decode`, which gives the
text back exactly, a literal meta symbol included.

The segmentation is the one of highest total piece score (of equal ones, that with the longest last piece). For a model
whose scores are merge ranks this is not the order in which merges would be applied."""
from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobstrata.llm.words import list_array, small_batches

META = "▁"
FALLBACK_PENALTY = 10.0
CACHED_UNITS = 1 << 18
CACHED_CHARS = 64


@dataclass(frozen=True)
class Vocabulary:
    """surface: text of each id (None: a control symbol), score of each id, ids of the 256 bytes."""
    surface: tuple[bytes | None, ...]
    matchable: tuple[bool, ...]
    score: tuple[float, ...]
    byte_ids: tuple[int, ...]


def load_vocabulary(model_file: str) -> Vocabulary:
    """Pieces and scores of a SentencePiece model with byte fallback, read on the driver (its size is the vocabulary's)."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    surface, matchable, score, byte_ids = [], [], [], [-1] * 256
    for i in range(sp.vocab_size()):
        piece, special = sp.id_to_piece(i), sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surface.append(bytes([int(piece[3:5], 16)]))
        else:
            surface.append(None if special else piece.replace(META, " ").encode())
        matchable.append(not special and not sp.is_byte(i))
        score.append(sp.get_score(i))
    if min(byte_ids) < 0:
        raise ValueError("the model has no byte pieces, so texts could not be given back")
    return Vocabulary(tuple(surface), tuple(matchable), tuple(score), tuple(byte_ids))


class Encoder:
    def __init__(self, v: Vocabulary):
        self.automaton, self.byte_ids, crossing, has_break = ahocorasick.Automaton(), v.byte_ids, False, False
        self.single = set()
        for i, (s, ok) in enumerate(zip(v.surface, v.matchable)):
            if ok:
                piece = s.decode()
                self.automaton.add_word(piece, (len(piece), i, v.score[i]))
                crossing |= re.search("[^ ] ", piece) is not None
                has_break |= "\n" in piece
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.penalty = min(s for s, ok in zip(v.score, v.matchable) if ok) - FALLBACK_PENALTY
        # No piece has a blank after another character, so the best path of a text is that of its words side by side.
        self.units = re.compile("(?s).+" if crossing else " *[^ ]+| +" if has_break else "\n| *[^ \n]+| +")
        self.cache: dict[str, int] = {}
        self._reset()
        lens = [0 if s is None else len(s) for s in v.surface]
        self.flat = np.frombuffer(b"".join(s or b"" for s in v.surface), np.uint8)
        self.first = np.concatenate([[0], np.cumsum(lens)])

    def _reset(self) -> None:
        self.cache.clear()
        self.ids: list[int] = []
        self.at: list[int] = [0]

    def best(self, unit: str) -> list[int]:
        """Ids of the best path through one unit."""
        n = len(unit)
        score, back = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        fallback = [unit[p] not in self.single for p in range(n)]
        done = 0  # positions whose best score is final

        def close(upto: int) -> None:
            nonlocal done
            while done < upto:
                done += 1
                if fallback[done - 1] and score[done - 1] + self.penalty > score[done]:
                    score[done], back[done] = score[done - 1] + self.penalty, (done - 1, -1)

        for last, (size, i, s) in self.automaton.iter(unit):
            close(last)
            start = last + 1 - size
            if score[start] + s > score[last + 1]:
                score[last + 1], back[last + 1] = score[start] + s, (start, i)
        close(n)
        out: list[int] = []
        while n:
            start, i = back[n]
            out += [i] if i >= 0 else [self.byte_ids[b] for b in reversed(unit[start:n].encode())]
            n = start
        return out[::-1]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin. Empty texts have none."""
        if len(self.at) > CACHED_UNITS:
            self._reset()
        cache, index, counts = self.cache, [], []
        for t in texts:
            found = self.units.findall(" " + t) if t else []
            before = len(index)
            for u in found:
                k = cache.get(u)
                if k is None:
                    self.ids += self.best(u)
                    k = len(self.at) - 1
                    self.at.append(len(self.ids))
                    if len(u) <= CACHED_CHARS:
                        cache[u] = k
                index.append(k)
            counts.append(len(index) - before)
        ids, first = gather(np.array(self.ids, np.int32), np.array(self.at, np.int64), np.array(index, np.int64))
        return ids, first[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in a row without the blanks put before them, and where each begins."""
        flat, at = gather(self.flat, self.first, ids)
        begin = at[first]
        drop = begin[:-1][np.diff(begin) > 0]
        keep = np.ones(len(flat), bool)
        keep[drop] = False
        return flat[keep], begin - np.concatenate([[0], np.cumsum(np.diff(begin) > 0)])


def gather(flat: np.ndarray, first: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the runs flat[first[i]:first[i+1]] for i in index, and where each begins."""
    lens = first[index + 1] - first[index]
    at = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    return flat[np.arange(at[-1]) + np.repeat(first[index] - at[:-1], lens)], at


def _worker(v):
    """The task's encoder; kept for all batches that this Python worker sees."""
    if getattr(_worker, "of", None) != v.value.score:
        _worker.of, _worker.made = v.value.score, Encoder(v.value)
    return _worker.made


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None) -> DataFrame:
    """docs with the ids of each text; with `check_col` also whether decoding them gave the text back.

    Null and empty texts have no ids (a null text counts as empty); rows that repeat are encoded one by one."""
    v = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = docs.columns

    def run(batches):
        enc = _worker(v)
        for rows, data, offsets in small_batches(batches, text_col):
            raw = data.tobytes()
            ids, first = enc.encode([raw[a:b].decode() for a, b in zip(offsets, offsets[1:])])
            out = [rows.column(c) for c in names] + [list_array(ids, first, pa.int32())]
            if check_col:
                back, at = enc.decode(ids, first)
                whole = len(back) == len(data) and np.array_equal(at, offsets) and np.array_equal(back, data)
                same = [True] * rows.num_rows if whole else [back[a:b].tobytes() == raw[c:d] for a, b, c, d in zip(at, at[1:], offsets, offsets[1:])]
                out.append(pa.array(same, pa.bool_()))
            yield pa.RecordBatch.from_arrays(out, names=names + [ids_col] + ([check_col] if check_col else []))

    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(check_col, T.BooleanType())] if check_col else [])
    return docs.mapInArrow(run, T.StructType(docs.schema.fields + added))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with the text of each id list; null or no ids give an empty text."""
    v = rows.sparkSession.sparkContext.broadcast(vocabulary)
    names = rows.columns

    def run(batches):
        enc = _worker(v)
        for b in batches:
            lists = [x.as_py() or [] for x in b.column(ids_col)]
            flat, at = enc.decode(np.array([i for x in lists for i in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64))
            text = flat.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array([text[s:e].decode() for s, e in zip(at, at[1:])], pa.string())], names=names + [text_col])

    return rows.mapInArrow(run, T.StructType(rows.schema.fields + [T.StructField(text_col, T.StringType())]))


def encoded_documents(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_pieces, ids, round_trip (decoding the ids gave the whole text back)."""
    one = docs.select(F.col(id_col).alias("_sp_id"), F.col(text_col).alias("_sp_text"))
    e = encode(one, vocabulary, "_sp_text", "_sp_ids", "_sp_same")
    return e.select(F.col("_sp_id").alias(id_col), F.size("_sp_ids").cast("long").alias("n_pieces"), F.col("_sp_ids").alias("ids"), F.col("_sp_same").alias("round_trip"))
