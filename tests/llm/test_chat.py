from spectraloom.llm.chat import rotate


def test_masks_cover_what_the_assistant_says(spark):
    rows = [(1, 0, "system", "be kind", "x"), (1, 1, "ann", "hi <|im_end|>\n", "x"), (1, 2, "bob", "é", "x"), (1, 3, "ann", None, "x"), (1, 3, "ann", None, "x"), (2, None, None, "", "x"), (2, 5, "", "late", "x"), (3, 0, "system", "alone", "x"), (None, 0, "ann", "lost", "x"), (4, 0, "ann", "w " * 50000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, Part string")
    got = {(r.conv_id, r.part, r.perspective): r for r in rotate(df).collect()}
    assert sorted(got) == [(1, 0, "ann"), (1, 0, "bob"), (2, -1, "unknown"), (2, 0, "unknown"), (4, 0, "ann")]
    ann, bob = got[1, 0, "ann"], got[1, 0, "bob"]
    said = lambda r: [r.text[a:b] for a, b in zip(r.mask_starts, r.mask_ends)]
    assert said(ann) == ["hi <| im_end|>\n<|im_end|>", "<|im_end|>", "<|im_end|>"] and said(bob) == ["é<|im_end|>"]
    assert ann.text.startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi ") and "user name=bob\né" in ann.text
    assert "user name=ann" in bob.text and "<|im_start|>assistant\né<|im_end|>\n" in bob.text


def test_parts_make_the_whole(spark):
    rows = [(7, t, f"s{t % 3}", f"t{t}") for t in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts, whole = rotate(df, turns_per_part=8).collect(), rotate(df).collect()
    for w in whole:
        own = sorted((p for p in parts if p.perspective == w.perspective), key=lambda p: p.part)
        assert "".join(p.text for p in own) == w.text and sum(p.n_turns for p in own) == 50


def test_empty_table(spark):
    assert rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
