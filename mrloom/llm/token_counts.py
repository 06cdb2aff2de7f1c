"""Token counts under a unigram vocabulary, by dynamic programming over a trie of the pre-tokens.

A pre-token is a word with the word mark before it. Its tokens are those of the segmentation into
pieces with the greatest sum of log probabilities (the forward score at its last character); characters that no
piece covers cost one token per UTF-8 byte. The distinct pre-tokens of a stretch of texts that a worker does not know
yet are walked in sorted order, which is the order of a depth-first walk of their trie: the forward scores of a
shared prefix stand on a stack and are computed once, and the score at a pre-token's end gives its
count. Counts last from stretch to stretch, up to a bound. Texts never move, and each is counted where it is read; the
vocabulary goes to the tasks by broadcast (its size is that of its file).

No vocabulary with unigram scores is at hand and tokenizers are not trained here, so a piece's log probability follows its
rank in a public vocabulary; any other scores can be given instead.

Defined results: null and empty texts have 0 words and 0 tokens; very long words are walked like
others (each position looks back at most the longest piece); bytes that are no UTF-8 count as replacement characters; repeated rows give repeated results; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts, words

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Log probability of a byte that stands for part of an uncovered character.
BYTE_SCORE = -30.0


@cache
def vocabulary(path: str = VOCABULARY) -> tuple[dict[str, float], int]:
    """Piece to log probability, and the longest piece. Probabilities follow the pieces' ranks as 1 / (rank + 1)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    scores = {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}
    return scores, max(map(len, scores))


def piece_ends(scores: dict[str, float]) -> dict[str, float | None]:
    """Of every end of a piece its log probability, None if that end itself is no piece: a look back stops where no piece goes on."""
    return {p[k:]: None for p in scores for k in range(1, len(p))} | scores


def trie_counts(tokens: list[str], ends: dict[str, float | None], longest: int) -> dict[str, int]:
    """The token count of each of the sorted, distinct pre-tokens. ends: by piece_ends().

    best[i], count[i]: the forward score and token count of the first i characters of the path to
    the current trie node. Equal scores go to the fewer tokens.
    """
    out: dict[str, int] = {}
    best, count, before = [0.0], [0], ""
    for token in tokens:
        shared, most = 0, min(len(token), len(before))
        while shared < most and token[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(token) + 1):
            letter = token[end - 1]
            width = 1 if letter < "\x80" else len(letter.encode("utf-8", "surrogatepass"))
            score, n = best[-1] + BYTE_SCORE * width, count[-1] + width
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                piece = ends.get(token[start:end], 0)
                if piece == 0:
                    break
                if piece is not None:
                    s, c = best[start] + piece, count[start] + 1
                    if s > score or s == score and c < n:
                        score, n = s, c
            best.append(score)
            count.append(n)
        out[token] = count[-1]
        before = token
    return out


#: Counts that a worker keeps (beyond this it starts afresh), and bytes of texts whose new pre-tokens make a trie.
KEPT_COUNTS, PIECE = 300_000, 4 << 20


def _counter(held):
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, longest = held.value
        ends = piece_ends(scores)
        known: dict[bytes, int] = {}
        for batch in batches:
            n_words: list[int] = []
            n_tokens: list[int] = []
            for piece in pieces(batch):
                split = [words(t) for t in piece]
                if len(known) > KEPT_COUNTS:
                    known = {}
                new = {w: MARK + w.decode("utf-8", "replace") for w in {w for t in split for w in t} - known.keys()}
                counts = trie_counts(sorted(set(new.values())), ends, longest)
                known.update((w, counts[token]) for w, token in new.items())
                n_words += map(len, split)
                n_tokens += (sum(map(known.__getitem__, t)) for t in split)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], schema=out)

    return run


def pieces(batch: pa.RecordBatch) -> Iterator[list[bytes | None]]:
    """Consecutive texts of about PIECE bytes."""
    held, size = [], 0
    for text in texts(batch):
        held.append(text)
        size += len(text or b"")
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary_path: str = VOCABULARY, scores: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row. scores: pieces with their log probabilities, in place of the file's."""
    rows = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    held = docs.sparkSession.sparkContext.broadcast((scores, max(map(len, scores))) if scores else vocabulary(vocabulary_path))
    return rows.mapInArrow(_counter(held), "doc_id long, n_words long, n_tokens long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
