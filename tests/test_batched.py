import random

import numpy as np

from kindred.functions import similarity as sim

FORMS = (("indel", sim.indel, sim.indels), ("jaro_winkler", sim.jaro_winkler, sim.jaro_winklers), ("token_set", sim.token_set, sim.token_sets))


def made(n):
    draw = random.Random(n)
    alphabets = ["ab", "abcdefgh ", "xyzé̌漢字 😀", " \x00a"]
    text = lambda: "".join(draw.choices(draw.choice(alphabets), k=draw.choice([0, 1, 2, 5, 17, 40, 63, 64, 65, 128, 130, 300])))
    pairs = [(text(), text()) for _ in range(n)]
    pairs += [(x, x[: len(x) // 2] + "q" + x[len(x) // 2 :]) for x, _ in pairs[: n // 3]] + [(x, x) for x, _ in pairs[:20]]
    pairs += [("martha", "marhta"), ("dwayne", "duane"), ("dixon", "dicksonx"), ("abcdxyz", "abcqrst"), ("", ""), ("", "a"), ("a b", "b a"), ("a" * 600, "ba" * 500), ("ab" * 400, "b" * 3)]
    draw.shuffle(pairs)
    return pairs


def test_batches_equal_single_pairs():
    """The same to the last bit, whatever lengths stand together in a batch."""
    for size in (1, 3, 1500):
        pairs = made(size)
        for name, one, many in FORMS:
            got = many([a for a, _ in pairs], [b for _, b in pairs])
            want = np.array([one(a, b) for a, b in pairs])
            assert got.shape == want.shape and np.array_equal(got, want), (name, [p for p, g, w in zip(pairs, got, want, strict=True) if g != w][:3])
    for _, _, many in FORMS:
        assert many([], []).shape == (0,)


def test_faster_by_far():
    import time

    pairs = [(a[:40], b[:40]) for a, b in made(4000) if len(a) > 20 and len(b) > 20]
    pairs = pairs * (5000 // len(pairs) + 1)
    for _, one, many in FORMS[:2]:
        began = time.process_time()
        want = [one(a, b) for a, b in pairs]
        single = time.process_time() - began
        began = time.process_time()
        got = many([a for a, _ in pairs], [b for _, b in pairs])
        together = time.process_time() - began
        print(single / together)
        assert got.tolist() == want and together < single / 3
