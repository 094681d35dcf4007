"""Decontamination against a brute-force version, and slots that must agree across alignments."""

import random
from collections import defaultdict

import pytest

from akshara.llm.decontamination import LITERAL, SHARE, WINDOW, contaminated

UNITS = ("km", "hours")


def words_of(text):
    """(canonical word, value) of a text whose capitalised words all stand inside sentences."""
    out = []
    for w in text.split():
        kind = "#" if w.isdigit() else "@" if w[0].isupper() else "%" if w in UNITS and out and out[-1][0] == "#" else w
        out.append((kind, w.lower()))
    return out


def one_to_one(pairs):
    return len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def brute(docs, items):
    out = {}
    for item, text in items:
        own = words_of(text)
        slots = lambda i: [(k, own[i + k][1]) for k in range(WINDOW) if own[i + k][0] in "#@%"]  # noqa: E731, B023
        places = [i for i in range(len(own) - WINDOW + 1) if len(slots(i)) <= WINDOW * LITERAL]
        for doc, body in docs:
            theirs = words_of(body)
            found, ways = set(), defaultdict(lambda: (set(), set()))
            for i in places:
                for j in range(len(theirs) - WINDOW + 1):
                    if all(own[i + k][0] == theirs[j + k][0] for k in range(WINDOW)):
                        if not slots(i):
                            found.add(i)
                            continue
                        at, pairs = ways[j - i]
                        at.add(i)
                        pairs.update((v, theirs[j + k][1]) for k, v in slots(i))
            ordered = sorted({(-len(at), tuple(sorted(at)), tuple(sorted(pairs))) for at, pairs in ways.values() if one_to_one(pairs)})
            taken = set()
            for _, at, pairs in ordered:
                if one_to_one(taken | set(pairs)):
                    taken |= set(pairs)
                    found.update(at)
            if places and len(found) / len(places) >= SHARE:
                out[doc, item] = (len(found), len(places), sum(a != b for a, b in taken))
    return out


def found(spark, docs, items):
    rows = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): (r.n_windows, r.item_windows, r.changed_slots) for r in rows.collect()}


ITEM = "today the old friend of Anna walks slowly for 3 hours to the quiet river while the brother of Anna rides for 7 km over the long bridge and waits there"


@pytest.mark.parametrize("word", ["", "rather "])
def test_slots_agree_across_alignments(spark, word):
    twice = ITEM.replace("while", word + "while")
    docs = [(1, twice.replace("Anna", "Mary").replace("3", "14")), (2, twice.replace("Anna", "John", 1).replace("Anna", "Mary")), (3, twice), (4, twice.replace("7", "3")), (5, f"{twice.replace('Anna', 'John')} then {twice.replace('Anna', 'Mary')}")]
    got = found(spark, docs, [(1, ITEM)])
    assert got == brute(docs, [(1, ITEM)])
    # John and Mary for one Anna, 3 for both 3 and 7: not the same question
    assert {d for d, _ in got} == {1, 3, 5}


@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination_against_brute_force(spark, seed):
    rng = random.Random(seed)
    plain, names, numbers = "the old cat sees my red house near its quiet lake".split(), ["Anna", "John", "Mary"], ["3", "4", "15"]

    def sentence(n):
        out = ["then"]
        while len(out) < n:
            kind = rng.random()
            out += [rng.choice(names)] if kind < 0.12 else [rng.choice(numbers)] + [rng.choice(UNITS)] * (rng.random() < 0.5) if kind < 0.25 else [rng.choice(plain)]
        return " ".join(out)

    items = [(i, sentence(rng.randrange(12, 40))) for i in range(12)]
    docs = []
    for d in range(120):
        words = rng.choice(items)[1].split()
        change = {w: rng.choice(names if w in names else numbers) for w in names + numbers}
        kind = d % 4
        if kind:
            words = [change[w] if w in change and (kind < 3 or rng.random() < 0.5) else w for w in words]
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(1, len(words)), rng.choice(plain))
        docs.append((d, f"{sentence(9)} {' '.join(words)} {sentence(rng.randrange(3, 30))} {' '.join(words[:20])}"))
    want = brute(docs, items)
    assert found(spark, docs, items) == want and 20 < len(want)
