"""What is flagged follows from the documents, not from the labels' toxic share."""

import random

import numpy as np
import pytest

from panelweave.llm import toxicity
from tests.llm.test_text_models import table, words


@pytest.mark.parametrize("more_clean, more_toxic", [(900, 0), (0, 150)])
def test_flags_follow_the_documents(spark, more_clean, more_toxic):
    rng = random.Random(31)
    bad = [i % 6 == 0 for i in range(600)] + [False] * more_clean + [True] * more_toxic
    texts = [f"{words(rng, 30)}{' vile rotten scoundrel' if b else ''} {words(rng, 30)}" for b in bad]
    labels = spark.createDataFrame([(i, 1, int(bad[i])) for i in range(600) if i % 7 < 4], "doc_id long, quality int, toxic int")
    got = toxicity.op8(table(spark, texts), labels).collect()
    assert sum(r.predicted != bad[r.doc_id] for r in got) <= 0.02 * len(got)


def test_cut_parts_known_documents():
    clean, toxic = np.linspace(-6, -2, 850), np.linspace(1, 5, 150)
    assert toxicity.cut_between(toxic, clean, 0.15) == pytest.approx(-0.5)
    # One stray label on either side moves nothing; one kind alone leaves the sign.
    assert toxicity.cut_between(np.append(toxic, -5.0), np.append(clean, 4.0), 0.15) == pytest.approx(-0.5)
    assert toxicity.cut_between(toxic, clean[:0], 0.15) == 0 == toxicity.cut_between(toxic[:0], clean, 0.15)
