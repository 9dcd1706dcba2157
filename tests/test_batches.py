"""T1 / T2 / T2b on small token arrays."""

from reasonloop.operators import batches as B


def test_concat_mask_pad_and_cut(spark):
    df = spark.createDataFrame([(0, [1, 2], [3, 4, 5]), (0, [7], [8]), (1, [9], [1, 2, 3, 4, 5, 6])],
                               "batch_id int, prompt_ids array<int>, target_ids array<int>")
    m = B.concat_and_mask(df)
    out = sorted((r.batch_id, r.input_ids, r.attention_mask, r.labels, r.max_len)
                 for r in B.pad_batches(m, max_seq_len=4, pad_id=0).collect())
    assert out == [
        (0, [1, 2, 3, 4], [1, 1, 1, 1], [-100, -100, 3, 4], 4),
        (0, [7, 8, 0, 0], [1, 1, 0, 0], [-100, 8, -100, -100], 4),
        (1, [9, 1, 2, 3], [1, 1, 1, 1], [-100, 1, 2, 3], 4),
    ]
    un = sorted((r.batch_id, len(r.input_ids)) for r in B.pad_batches(m, max_seq_len=None).collect())
    assert un == [(0, 5), (0, 5), (1, 7)]
    for cap in (4, None):        # lengths first, arrays after: the same rows
        rows = lambda d: sorted((r.batch_id, r.input_ids, r.attention_mask, r.labels, r.max_len) for r in d.collect())
        assert rows(B.padded_examples(df, max_seq_len=cap)) == rows(B.pad_batches(m, max_seq_len=cap))
