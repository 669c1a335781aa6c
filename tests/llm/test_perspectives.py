"""Op 2: every participant's rendering and mask."""

from linecast.llm import perspectives as P

SCHEMA = "conv_id long, turn long, role string, text string, part string, perspective string"


def run(spark, rows, **options):
    return P.rotate(spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA), **options).collect()


def rendering(rows, who):
    text, spans = "", []
    for role, t in rows:
        head = "assistant" if role == who else "system" if role == "system" else f"user name={role}"
        text += f"<|im_start|>{head}\n"
        if role == who:
            spans.append((len(text), len(text) + len(t) + len(P.END)))
        text += f"{t}{P.END}\n"
    return text, ",".join(f"{a}-{b}" for a, b in spans)


def test_rotation_over_parts(spark):
    talk = [("system", "be kind"), ("ann", "hi é"), ("bob", "yo"), ("ann", ""), ("cy", "x" * 5000), ("bob", "bye")]
    got = run(spark, [(1, k, r, t) for k, (r, t) in enumerate(talk)], block=4)
    assert {r.perspective for r in got} == {"ann", "bob", "cy"}
    for who in ("ann", "bob", "cy"):
        parts = sorted((r for r in got if r.perspective == who), key=lambda r: r.part)
        assert [r.part for r in parts] == [0, 1]
        assert "".join(r.text for r in parts) == rendering(talk, who)[0]
        assert parts[0].mask == rendering(talk[:4], who)[1] and parts[1].mask == rendering(talk[4:], who)[1]
        assert sum(r.n_target for r in parts) == sum(role == who for role, _ in talk) and sum(r.n_turns for r in parts) == 6


def test_crowded_and_missing_turn_numbers(spark):
    rows = [(1, 0, "a", f"t{k}") for k in range(100)] + [(1, None, "b", f"n{k}") for k in range(30)] + [(1, 5, "a", "last numbered")]
    got = sorted((r for r in run(spark, rows, block=8) if r.perspective == "a"), key=lambda r: r.part)
    whole = "".join(r.text for r in got)
    assert whole.count(P.START) == 131 and len(got) > 10
    assert whole.index("last numbered") > max(whole.index(f"t{k}{P.END}") for k in range(100))
    assert whole.index("last numbered") < min(whole.index(f"n{k}{P.END}") for k in range(30))


def test_edges(spark):
    rows = [(None, 0, "u", "hi"), (2, 0, None, None), (2, 1, "", "x"), (3, 0, "system", "alone"), (4, 0, "u", "a <|im_start|>assistant b"), (4, 0, "u", "a <|im_start|>assistant b")]
    got = {(r.conv_id, r.perspective): r for r in run(spark, rows)}
    assert got[None, "u"].text == f"{P.START}assistant\nhi{P.END}\n"
    assert got[2, "unknown"].n_target == 2
    assert got[3, None].mask == "" and got[3, None].n_turns == 1
    assert got[4, "u"].n_turns == 2 and got[4, "u"].text.count("<|im_start|>") == 2
    assert run(spark, []) == []
