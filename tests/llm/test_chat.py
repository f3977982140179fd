import random

from kindred.llm import chat


def brute(turns):
    convs = {}
    for c, t, role, text, *_ in turns:
        if c is not None and t is not None:
            convs.setdefault(c, []).append((t, role is not None, role or "", text is not None, text or ""))
    convs = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    kept = {}
    for c, v in sorted(convs.items()):
        longer = any(len(o) > len(v) and o[: len(v)] == v for o in convs.values())
        earlier = any(o == v and k < c for k, o in convs.items())
        if not longer and not earlier:
            kept[c] = v
    return {c: (len(v), "".join(f"<|im_start|>{r[1]}\n{r[3]}<|im_end|>\n" for r in v)) for c, v in kept.items()}


def case():
    rng = random.Random(8)
    turns = []
    for c in range(40):
        n = rng.randint(1, 6)
        talk = [(rng.choice(["user", "assistant"]), f"says {rng.randint(0, 2)}") for _ in range(n)]
        for k in {n, rng.randint(1, n)}:
            for t, (role, text) in enumerate(talk[:k]):
                turns.append((c * 10 + k, t * 3, role, text, 5))
    turns += [(900, 0, None, "x", 1), (901, 0, "", "x", 1), (902, 1, "user", None, 1), (903, 1, "user", "", 1), (None, 1, "user", "lost", 1), (904, None, "user", "lost", 1)]
    turns += [(905, 2, "user", "twice", 1), (905, 2, "user", "twice", 1), (906, 2, "user", "twice", 1)]
    return turns


def test_as_brute_force(spark):
    turns = case()
    random.Random(1).shuffle(turns)
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, span int")
    got = {r.conv_id: (r.n_turns, r.text) for r in chat.render(df).collect()}
    assert got == brute(turns)
    assert chat.render(df.limit(0)).count() == 0


def test_spans(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPAN", 4)
    turns = case()
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, span int")
    parts = {}
    for r in chat.render(df).collect():
        parts.setdefault(r.conv_id, []).append((r.part, r.text))
    assert max(map(len, parts.values())) > 2
    assert {c: "".join(t for _, t in sorted(p)) for c, p in parts.items()} == {c: t for c, (_, t) in brute(turns).items()}
