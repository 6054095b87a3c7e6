"""Chat examples: exact round trip and the expansion written out by hand."""

import hashlib

from rentlens.llm import chat_targets as C

PROBE = "</s>[INST] ok [/INST]"
CONVS = {
    -1: [("user", PROBE), ("assistant", PROBE)],
    1: [("system", "be\nkind"), ("user", "<|assistant|>\n\\lt; \\bs;"), ("assistant", "|> a \\"), ("user", ""), ("assistant", None), ("user", "tail 😀")],
    2: [("user", "alone")],
    3: [("assistant", "first"), ("assistant", "second"), (None, "x"), ("a|>\nb", "y")],
    4: [("user" if i % 2 == 0 else "assistant", f"turn {i} " * 50) for i in range(200)],
}
SCHEMA = "conv_id long, turn long, role string, text string, block string, position string, example long"


def frame(spark, convs=CONVS):
    return spark.createDataFrame([(c, t, r, x, "b", "p", 0) for c, turns in convs.items() for t, (r, x) in enumerate(turns)], SCHEMA)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_digest(spark):
    out = {r.conv_id: r for r in C.digest(C.expand(frame(spark))).collect()}
    assert set(out) == set(CONVS)
    for c, turns in CONVS.items():
        loss = "".join(x or "" for r, x in turns if r == "assistant")
        r = out[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a or ''}\n{x or ''}\n" for a, x in turns)))
        assert (r.loss_chars, r.loss_sha256, r.n_examples) == (len(loss), sha(loss), sum(a == "assistant" for a, _ in turns))


def test_render(spark):
    rows = C.expand(frame(spark))
    text = {c: [b.block for b in rows.where(f"conv_id = {c}").orderBy("position").collect()] for c in CONVS}
    seen = {c: [] for c in CONVS}
    for r in C.render(rows).orderBy("conv_id", "example").collect():
        targets = [i for i, (a, _) in enumerate(CONVS[r.conv_id]) if a == "assistant"]
        k = targets[r.example]
        assert r.text == "".join(text[r.conv_id][:k + 1])
        safe = CONVS[r.conv_id][k][1] or ""
        for a, b in C.ESCAPES:
            safe = safe.replace(a, b)
        assert r.text[r.loss_start:r.loss_start + r.loss_chars] == safe
        seen[r.conv_id].append(r.example)
    assert all(seen[c] == list(range(sum(a == "assistant" for a, _ in turns))) for c, turns in CONVS.items())
    marks = text[-1]
    assert all(m.count("</s>") == 1 and "[INST]" not in m for m in marks)


def test_edges(spark):
    assert C.digest(C.expand(frame(spark, {}))).count() == 0
    rows = [(None, 0, "user", "a", "", "", 0), (None, None, "assistant", "b", "", "", 0), (2**60 + 1, 0, "assistant", "c", "", "", 0), (2**60 + 1, 0, "assistant", "c", "", "", 0)]
    out = {r.conv_id: r for r in C.digest(C.expand(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert out[None].turns_sha256 == sha("assistant\nb\nuser\na\n") and out[None].loss_sha256 == sha("b")
    assert out[2**60 + 1].n_turns == 2 and out[2**60 + 1].loss_sha256 == sha("cc")


def test_digest_reads_written_examples(spark, monkeypatch):
    """What the digests tell comes from the written examples: one that is written wrong shows."""
    rows = C.expand(frame(spark))
    out = {r.conv_id: r for r in C.digest(rows).collect()}
    examples = C.render(rows).collect()
    assert {c: (r.n_examples, r.examples_chars) for c, r in out.items()} == {
        c: (sum(e.conv_id == c for e in examples), sum(len(e.text) for e in examples if e.conv_id == c)) for c in CONVS}
    rest = {r.key: r.text for r in C.written(rows).where("example is null").collect()}
    assert set(rest) == {"1", "2", "3"} and [a for a, _ in C.read_turns(rest["3"])] == ["assistant", "assistant", "", "a|>\nb"]
    real = C.written
    monkeypatch.setattr(C, "written", lambda *a: real(*a).selectExpr("key", "example", "replace(text, 'first', 'FIRST') AS text", "loss_start", "loss_chars"))
    assert {r.conv_id: r for r in C.digest(rows).collect()}[3].loss_sha256 == sha("FIRSTsecond")
