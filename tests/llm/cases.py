"""Constants of the operators' tests."""

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\x0c\r ", "en", None, 7),
    (4, "é ü ñ ß\n" * 30, "fr", "a", 1),
    (5, LONG, "en", "b", 2),
    (5, LONG, "en", "b", 2),
    (6, "mail me at joe@x.org or +1 (555) 010-2030, token = \"abcdef123456\"", "en", None, 3),
    (7, "same words here " * 40, "en", "b", 4),
    (8, "same words here " * 40, "en", "b", 4),
    (None, "no id at all but some words to read", "en", "b", 5),
    (9, "a" * 1000, None, "c", None),
]
