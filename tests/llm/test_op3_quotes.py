import random

from foliomill.llm import quotes


def test_levels_and_announcing_lines():
    text = "Thanks!\n\nOn Monday, Ann wrote:\n> first line\n> second\n>> deeper one\n> > deeper two\n>>> third\nown again\nHe wrote:"
    assert quotes.passages(text) == [(0, "Thanks!\n"), (1, "first line\nsecond"), (2, "deeper one\ndeeper two"), (3, "third"), (0, "own again\nHe wrote:")]
    assert quotes.passages("") == [(0, "")]


def thread(seed, n=60):
    """Messages that quote earlier ones, with the truth."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    own, parent, texts = [], [], []
    for t in range(n):
        body = [" ".join(word() for _ in range(r.randrange(4, 9))) for _ in range(r.randrange(1, 4))]
        own.append(body)
        p = r.randrange(t) if t and r.random() < 0.6 else None
        parent.append(p)
        lines = []
        if p is not None:
            q = own[p] if r.random() < 0.5 else own[p][:1]
            lines = ["On some day someone wrote:"] + ["> " + x.upper() for x in q]
            if parent[p] is not None:
                lines += [">> " + x for x in own[parent[p]]]
        texts.append("\n".join([*lines, *body] if r.random() < 0.5 else [*body, "", *lines]))
    return texts, parent, own


def test_links_and_order_against_the_truth(spark):
    rows, truth = [], {}
    for conv in range(4):
        texts, parent, own = thread(conv)
        rows += [(conv, t, "user", x, "z") for t, x in enumerate(texts)]
        truth |= {(conv, t): (parent[t], "\n".join(own[t])) for t in range(len(texts))}
    got = quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string").repartition(5)).collect()
    assert len(got) == len(rows)
    root = lambda c, t: t if truth[c, t][0] is None else root(c, truth[c, t][0])
    for r in got:
        key = (r["conv_id"], r["turn"])
        assert (r["parent_turn"], r["text"].strip("\n")) == truth[key] and r["thread"] == root(*key)
    for c in range(4):
        own = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(60))
        assert [(r["thread"], r["turn"]) for r in own] == sorted((r["thread"], r["turn"]) for r in own)


def test_a_sentence_of_a_line_is_found(spark):
    rows = [(1, 0, "u", "First thought. Second one, longer! Ok?"), (1, 1, "u", "> second one, longer!\nyes"), (1, 2, "u", "> ok\n> first thought"), (1, 3, "u", "> Yes!")]
    got = {r["turn"]: r["parent_turn"] for r in quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 1}


def test_nulls_repeats_and_empty(spark):
    rows = [(1, 0, "u", "a long enough line"), (1, 1, None, "> a long enough line\nyes"), (1, 1, None, "> a long enough line\nyes"), (1, 2, "u", "> nobody said this line"), (1, 3, "u", None), (None, 0, "u", "a long enough line"), (None, 1, "u", "> a long enough line"), (2, None, "u", "> a long enough line"), (1, 4, "u", "> yes"), (1, 0, "u", "> a long enough line")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.reply_order(df).collect()
    assert len(got) == len(rows)
    assert sorted((r["turn"], r["parent_turn"]) for r in got if r["conv_id"] == 1 and r["parent_turn"] is not None) == [(1, 0), (1, 0), (4, 1)]
    assert all(r["parent_turn"] is None for r in got if r["conv_id"] != 1)
    assert sorted(r["position"] for r in got if r["conv_id"] == 1) == list(range(7))
    assert quotes.reply_order(df.where("false")).count() == 0


def test_a_hot_conversation_and_line(spark):
    rows = [(7, t, "u", "the same common line here" if t % 2 else f"> the same common line here\nreply {t}") for t in range(2000)]
    got = quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r["position"] for r in got) == list(range(2000))
    assert {r["parent_turn"] for r in got if r["turn"] % 2 == 0 and r["turn"] > 0} == {1}
