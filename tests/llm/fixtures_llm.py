"""Rows that operators must take."""

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = ("the river ran past the old mill and the boys who fished there knew each stone by name while their fathers worked in "
         "the fields above until the bell of the church called everyone home for bread soup and a story about the sea")


def hard_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = " ".join(f"{w}{k % 97}" for k in range(400) for w in PROSE.split()[:40])
    return [
        (1, PROSE, "en", "a", 10), (2, PROSE.upper(), "en", "b", 10), (2, PROSE.upper(), "en", "b", 10), (3, None, None, None, None), (4, "", "de", "a", 0),
        (5, "   \n\t ", "fr", "", 4), (6, long, "en", "a", 1), (7, "The Gate.\nÉcole Straße", "fr", "ç", 3), (8, "É", "fr", "a", 1), (9, "é", "fr", "a", 1), (None, "x y z", "en", None, 3),
        (10, PROSE + " again", "en", "c", 9), (11, "line one is here now\nline 12 of the page ends\nline one is here now", "en", "a", 1),
    ]
