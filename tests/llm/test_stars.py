"""Near copies of one text that is not there: what is compared grows with the group, not with its square."""

import random
from collections import Counter

import pytest

from leafmark.llm import bagminhash


def near_copies(members, seed):
    """Copies of a text of 300 words with 1 to 12 words replaced; in every fifth, by words that another one has too."""
    rng = random.Random(seed)
    base = [f"w{seed}x{i}" for i in range(300)]
    out = []
    for i in range(members):
        words = list(base)
        for at in rng.sample(range(300), 1 + i % 12):
            words[at] = f"new{seed}x{i}x{at}"
        if i % 5 == 4:
            words = out[-1].split()
            words[rng.randrange(300)] = f"again{i}"
        out.append(" ".join(words))
    return out


def bag(text):
    words = text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def classes(texts):
    """Least member of each text's class, from all pairs."""
    bags, least = [bag(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(bags):
        for j in range(i):
            shared = sum((x & bags[j]).values())
            if shared * 9 >= (x.total() + bags[j].total()) * 4 and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = [low if k == high else k for k in least]
    return least


@pytest.mark.parametrize("members", [150])
def test_members_of_a_star_are_compared_a_few_times_each(spark, monkeypatch, members):
    compared, stored = {}, bagminhash.stored

    def counted(df, name):
        table = stored(df, name)
        if name.endswith("_pairs"):
            compared[name] = table.count()
        return table

    monkeypatch.setattr(bagminhash, "stored", counted)
    texts = near_copies(members, 1) + near_copies(members // 3, 2)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(rows).collect()}
    assert [found[i] for i in range(len(texts))] == classes(texts)
    assert len(set(found.values())) > members // 10
    assert 0 < sum(compared.values()) < 4 * len(texts), compared


def test_rows_with_wanted_keys_stay(spark):
    keys = [0, -1, 1, 7, 8, 2**15, 2**24, -(2**63), 2**63 - 1] + [k * 0x9E3779B97F4A7C1 % 2**63 for k in range(50)]
    rows = spark.range(3000).selectExpr("xxhash64(id) as key").unionByName(spark.createDataFrame([(k,) for k in keys], "key long"))
    wanted = spark.createDataFrame([(k,) for k in keys], "key long")
    found = [r.key for r in bagminhash._perhaps(rows, wanted, "key").collect()]
    assert sorted(found)[0] == -(2**63) and set(keys) <= set(found) and len(found) < len(keys) + 300
    assert bagminhash._perhaps(rows, wanted.limit(0), "key").columns == ["key"]
