"""Memory of packing, whatever the size of a batch."""

import random

import public_tokenizers
import pyarrow as pa

from archivolt.llm.packing import pieces_of
from archivolt.llm.tokens import Encoder
from tests.llm.test_memory import Caught, peak


class Chosen(Caught):
    def select(self, *_):
        return self


def test_a_large_batch_is_encoded_in_slices(spark):
    r = random.Random(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(5000)]
    batch = pa.record_batch({"doc_id": list(range(1500)), "text": [" ".join(r.choices(words, k=1000)) for _ in range(1500)]})
    assert batch.nbytes > 7_000_000
    path = public_tokenizers.path("word_bpe_49k.json")
    made = pieces_of(Chosen(), path, 2048)
    Encoder.at(path).encode(pa.array([" ".join(words)], pa.large_string()))
    assert peak(made, batch) < 40
