"""A group of edited copies is compared with the text that they were made from, whatever the order of its members."""

import random

import pytest

from beaconlake.llm import chosen_path


@pytest.mark.parametrize("turned", [False, True])
def test_few_candidates_in_a_group_of_edited_copies(spark, monkeypatch, turned):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(150)]
    texts = [" ".join(words)]
    for n in range(600):
        copy = list(words)
        for at in rng.sample(range(0, 150, 3), 1 + n % 4):
            copy[at] = f"x{rng.random()}"
        texts.append(" ".join(copy))
    rows, found, written = list(enumerate(texts)), {}, chosen_path.written

    def counted(df, name, *more):
        out = written(df, name, *more)
        found[name] = found.get(name, 0) + (out.count() if name == "candidates" else 0)
        return out

    monkeypatch.setattr(chosen_path, "written", counted)
    got = chosen_path.near_duplicates(spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.component_id for r in got} == {0}
    assert found["candidates"] <= len(rows)
