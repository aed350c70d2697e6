"""Rows that every operator must survive."""

EDGE = [
    (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "Éa ü — 漢字 😀\n\nx"), (5, "one"), (5, "one"), (5, "two words"), (None, "one"),
    (6, "word " * 3000), (7, "a" * 5000), (8, "\n" * 50), (9, "x" * 300 + "\n" + "y z " * 200), (-3, "neg id\r\nline"), (10, "\x0b\x0c\x1cq r s"),
]
