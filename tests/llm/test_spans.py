"""Spans of a benchmark too large to be held at hand."""

import random

from locusflow.llm import decontamination


def test_spans_are_cut_beyond_the_set(spark):
    """The join cuts what the set cuts, in null, clean and repeated texts too."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefghij", k=4))
    items = [[word() for _ in range(12)] for _ in range(8)]
    bench = spark.createDataFrame([(str(i), " ".join(w)) for i, w in enumerate(items)], "item_id string, text string")
    texts = [f"Start, {word()}! {' '.join(items[i % 8][:11])}; {word()}  {word()}. {' '.join(items[(i + 3) % 8])}" for i in range(10)]
    texts += [texts[0], "nothing  of it, here", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at_hand = sorted(decontamination.remove_spans(docs, bench).collect())
    joined = sorted(decontamination.remove_spans(docs, bench, set_windows=3).collect())
    assert joined == at_hand and len(joined) == len(texts)
    assert all(r.text != t for r, t in zip(joined[:11], texts, strict=False)) and [r.text for r in joined[11:]] == texts[11:]
