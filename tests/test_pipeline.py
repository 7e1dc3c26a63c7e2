from tagloom.operators import evaluate, features, labels, wordpiece
from tagloom.sources import readers


def test_files_to_scores(spark, tmp_path):
    """Token and vocabulary files to feature rows, to predictions, to a perfect score."""
    for n in (1, 2):
        text = "Aspirin\tB-Chem\nhelps\tO\n\nno\tO\naspirins\tS-Chem\n.\tO\n"
        (tmp_path / f"part{n}.tsv").write_text(text)
    vocab = tmp_path / "vocab.txt"
    vocab.write_text("\n".join(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "as", "##pirin", "##s", "help", "no", "."]) + "\n")

    tokens = readers.read_tokens(spark, [str(tmp_path / f"part{n}.tsv") for n in (1, 2)])
    label_ids = labels.label_dictionary(tokens.where("label IS NOT NULL"), ["file", "sent_id", "word_pos"])
    coded = labels.encode_labels(tokens, label_ids).drop("label").withColumnRenamed("label_id", "label")
    words = wordpiece.word_dictionary(wordpiece.word_counts(coded), readers.read_vocab(spark, str(vocab)))
    cfg = features.FeatureConfig(max_len=16, x_id=label_ids.agg({"id": "max"}).first()[0])
    rows = features.build_features(wordpiece.tokenize(coded, words), cfg, ["file"])

    got = rows.collect()
    assert len(got) == 2
    assert got[0]["piece_list"][:12] == ["[CLS]", "as", "##pirin", "help", "##s", "no", "as", "##pirin", "##s", ".", "[SEP]", "[PAD]"]
    assert got[0]["input_ids"][:12] == [3, 4, 5, 7, 6, 8, 4, 5, 6, 9, 4, 0]
    assert got[0]["label_x"][:11] == [0, 1, 3, 0, 3, 0, 2, 3, 3, 0, 0]

    preds = rows.selectExpr(
        "monotonically_increasing_id() AS seq_id", "label_ids AS logits", "label_ids AS labels", "input_mask AS mask",
        "is_start_label", "piece_list", "label_x", "is_weight_focus AS weight_focus_label",
    )
    for mode in ("normal", "X", "focus_weight", "first_piece"):
        top = evaluate.score_predictions(preds, label_ids, mode, ["seq_id"]).where("level = 'overall'").first()
        assert (top["gold"], top["correct"], top["f1"], top["tokens"]) == (4, 4, 1.0, 10), mode
