"""Chats are read back from their formatted text alone."""

from searchloom.llm import chat

TURNS = [(1, 0, "user", "hi </s> [INST]\x1b x"), (1, 1, "assistant", "[/INST] [ANSWER] no [/ANSWER]</s>"), (1, 2, "to]ol", "t [/ROLE]"), (2, 0, "user", "q"), (2, 1, "assistant", "")]


def read(spark, segments, template=None):
    rows = spark.createDataFrame(segments, "conv_id long, segment string, loss boolean, valid boolean, may_end boolean").coalesce(1)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.read_back(rows, template).collect()}


def segments_of(spark, template=None):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").coalesce(1)
    return [(r.conv_id, r.segment, r.loss, r.valid, r.may_end) for r in chat.format_chats(df, template).collect()]


def test_the_cut_of_the_text_does_not_matter(spark):
    whole = segments_of(spark)
    for size in (1, 5, 1000):
        cut = []
        for c in (1, 2):
            text = "".join(s[1] for s in whole if s[0] == c)
            cut += [(c, text[i : i + size], False, True, True) for i in range(0, len(text), size)]
        assert read(spark, cut) == read(spark, whole)


def test_without_escapes_turns_cannot_be_read_back(spark):
    class Bare(chat.Template):
        def escaped(self, text):
            return text

    bare = segments_of(spark, Bare())
    right, wrong = read(spark, segments_of(spark)), read(spark, bare)
    assert right[1][0] == 3 and wrong[1][:2] != right[1][:2] and wrong[1][3] != right[1][3]
    assert right[2] == wrong[2]
