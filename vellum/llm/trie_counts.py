"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a batch are visited in the order of their trie, that is sorted. Forward scores of a
unigram model (the best sum of piece scores up to each character, and its number of pieces) depend on the prefix
alone, so going from one pre-token to the next keeps those of the shared prefix and computes the rest. The count at
each terminal is stored and looked up for every occurrence, in this batch and later ones.

The pieces are those of a public vocabulary, never trained here. It has no probabilities, so the score of a piece is
that of its rank under Zipf's law, minus log(rank + 2); a character outside all pieces costs a byte piece, with the lowest score, for
each of its bytes. Of equally good cuts the one with fewer tokens counts.

Defined results: pre-tokens lie between ASCII white space and begin with the vocabulary's word mark; a null or empty
text has none; rows that repeat an id are counted one by one; a null id stays null; further columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import read

MARK = "▁"
#: Bytes of distinct pre-tokens whose counts a task remembers at a time, and bytes of text whose pre-tokens are visited at a time.
TERMINALS, VISIT_BYTES = 32 << 20, 4 << 20
#: Bytes that a remembered pre-token takes besides its own.
TERMINAL_BYTES = 100


def vocabulary_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_scores(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces by rank."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return {model.id_to_piece(i): -math.log(rank + 2) for rank, i in enumerate(plain)}


class Trie:
    """Terminal counts of pre-tokens; scores of the current path are one (score, -tokens) pair for each character."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.byte = -math.log(len(scores) + 2)
        self.counts: dict[bytes, int] = {}
        self.size = 0

    def insert(self, tokens: set[bytes]) -> None:
        more = sum(len(t) + TERMINAL_BYTES for t in tokens - self.counts.keys())
        if self.size + more > TERMINALS and self.counts:
            self.counts.clear()
            self.size, more = 0, sum(len(t) + TERMINAL_BYTES for t in tokens)
        self.size += more
        get, longest, byte = self.scores.get, self.longest, self.byte
        path, before = [(0.0, 0)], ""
        for word, raw in sorted((MARK + t.decode(), t) for t in tokens - self.counts.keys()):
            shared, limit = 0, min(len(before), len(word))
            while shared < limit and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                score, tokens_ = path[end - 1]
                n = len(word[end - 1].encode())
                best = (score + n * byte, tokens_ - n)
                for start in range(max(0, end - longest), end):
                    piece = get(word[start:end])
                    if piece is not None:
                        score, tokens_ = path[start]
                        if (found := (score + piece, tokens_ - 1)) > best:
                            best = found
                path.append(best)
            before = word
            self.counts[raw] = -path[-1][1]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) per row."""
    path = vocabulary or vocabulary_file()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(piece_scores(path))
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                words, to, size = [], at, 0
                while to < len(texts) and (to == at or size < VISIT_BYTES):
                    words.append((texts[to] or "").encode().split())
                    size += len(texts[to] or "")
                    to += 1
                trie.insert(set().union(*words))
                counts = [sum(map(trie.counts.__getitem__, w)) for w in words]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(map(len, words), pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])
                at = to

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))


SQL = None
