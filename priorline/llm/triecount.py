"""Token counts: unigram forward scores over a trie of the distinct pre-tokens."""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_texts, map_batches, type_of

SPACE = "▁"
KEEP_TERMINALS = 1_000_000  # counts of pre-tokens a worker remembers between batches
_MODELS: dict[str, tuple[dict[str, float], int]] = {}


def pieces(path: str) -> tuple[dict[str, float], int]:
    """(score of each piece, characters of the longest): a vocabulary file has ranks, and a piece of rank r scores -log(r + 2)."""
    if path not in _MODELS:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
        scores = {model.id_to_piece(i): -log(rank + 2) for rank, i in enumerate(plain)}
        _MODELS[path] = scores, max(map(len, scores))
    return _MODELS[path]


def trie_counts(words: list[str], scores: dict[str, float], longest: int) -> list[int]:
    """Tokens of each of the sorted, distinct ``words`` on its best path.

    Sorted words walk the trie depth first: what a word shares with the one before is scored already, and the
    forward scores are extended from there.  A node keeps (score, tokens) of the best split of its prefix; ties go to fewer
    tokens.  A character outside the vocabulary is one token for each of its bytes, each scored below the last piece.
    """
    worst = -2 * log(len(scores) + 2)
    best, count = [0.0], [0]
    before, out, get = "", [], scores.get
    for word in words:
        shared, limit = 0, min(len(before), len(word))
        while shared < limit and before[shared] == word[shared]:
            shared += 1
        del best[shared + 1:], count[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top, tokens = best[end - 1] + worst * size, count[end - 1] + size
            for start in range(max(0, end - longest), end):
                score = get(word[start:end])
                if score is not None:
                    score += best[start]
                    if score > top or score == top and count[start] + 1 < tokens:
                        top, tokens = score, count[start] + 1
            best.append(top)
            count.append(tokens)
        out.append(count[len(word)])
        before = word
    return out


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens): one row per row of ``docs``.

    Pre-tokens are the words of the whole text, each with a word mark before it.  The distinct new ones of a batch of documents form one
    trie; counts at its terminals are remembered for later batches.  No text is shuffled.  Null, empty and blank texts have
    none; repeated rows get equal counts; an empty table gives no rows.
    """
    known: dict[str, int] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, longest = pieces(path)
        texts = [t.split() for t in arrow_texts(batch.column(1))]
        fresh = sorted(set().union(*texts).difference(known)) if texts else []
        if len(known) + len(fresh) > KEEP_TERMINALS:
            known.clear()
            fresh = sorted(set().union(*texts))
        known.update(zip(fresh, trie_counts([SPACE + w for w in fresh], scores, longest)))
        total = [sum(map(known.__getitem__, words)) for words in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in texts], pa.int64()), pa.array(np.array(total, np.int64))],
                                          ["doc_id", "n_pretokens", "n_tokens"])

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(base, run, f"doc_id {type_of(docs, id_col)}, n_pretokens long, n_tokens long")
