from .test_quotes import run


def test_rewrapped_paragraph_of_a_longer_message(spark):
    rows = [
        (1, 0, "user", "Dear all,\n\nthe first paragraph goes on\nfor two lines here.\n \nAnother one follows\nand ends."),
        (1, 1, "assistant", "I see."),
        (1, 2, "user", "> the first\n> paragraph goes on for two\n> lines here.\n\nThis is what I mean."),
        (1, 3, "assistant", "> Dear all,\n>\n> another one\n> follows and ends.\nYes."),
    ]
    got = run(spark, rows)
    assert got[1, 3] == (1, 4, 1, "This is what I mean.")
    assert got[1, 4] == (1, 5, 2, "Yes.")
