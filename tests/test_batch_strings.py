"""Similarities of batches against their definitions, and the pair scores that are made of them."""

from __future__ import annotations

import random

import pyarrow as pa
from strings_by_hand import common_value, jaro_winkler_value

from cashloom.functions import batch_strings


def test_batches_are_what_single_pairs_give():
    rng = random.Random(3)
    makers = [
        lambda: "INV" + "".join(rng.choice("0123") for _ in range(rng.randrange(2, 9))), lambda: "".join(rng.choice("abcA ") for _ in range(rng.randrange(0, 14))),
        lambda: "CUSTOMER#" + "".join(rng.choice("0019") for _ in range(9)), lambda: "".join(rng.choice("aé🙂\x00") for _ in range(rng.randrange(0, batch_strings.MOST + 1))),
    ]
    for kinds in ((0,), (0, 1), (2,), (0, 1, 2, 3)):
        pairs = [(makers[rng.choice(kinds)](), makers[rng.choice(kinds)]()) for _ in range(3000)]
        a, b = (pa.array(x) for x in zip(*pairs, strict=True))
        assert batch_strings.jaro_winkler_all(a, b).tolist() == [jaro_winkler_value(*p) for p in pairs]
        assert batch_strings.common_letters_all(a[7:], b[7:]).tolist() == [common_value(*p) for p in pairs[7:]]


def test_candidates_are_compared_in_batches(spark, data):
    from cashloom.plans import registry

    plan = registry.QUERIES["mat4_candidates"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
