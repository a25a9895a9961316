"""Memory of steps in Python, whatever the size of a batch."""

import random
import tracemalloc

import pyarrow as pa

from archivolt.llm.decontamination import finder, grouped
from archivolt.llm.exact_spans import anchors_of


class Caught:
    """A table that gives the function of mapInArrow back."""

    def mapInArrow(self, made, _):  # noqa: N802
        return made


def peak(made, batch) -> float:
    """MB of Python and numpy that a step takes at most."""
    tracemalloc.start()
    for _ in made([batch]):
        pass
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_a_large_batch_is_looked_at_in_slices():
    r = random.Random(1)
    words = [f"word{i}" for i in range(5000)]
    texts = [" ".join(r.choices(words, k=1000)) for _ in range(1000)]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "dg": list(range(len(texts))), "text": texts})
    assert batch.nbytes > 7_000_000
    items = [{"item_id": i, "text": " ".join(texts[i].split()[:40])} for i in range(50)]
    assert peak(finder(grouped(items, 5), 5, 0.8), batch) < 60
    assert peak(anchors_of(Caught(), 200), batch) < 80
