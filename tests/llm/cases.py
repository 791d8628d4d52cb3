"""Documents for tests, with the hard cases."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    """n words, a new line after every ninth."""
    x, out = seed * 2654435761 % 2**32, []
    for i in range(n):
        x = (x * 1664525 + 1013904223) % 2**32
        out.append(WORDS[(x >> 16) % len(WORDS)] + WORDS[(x >> 8) % len(WORDS)] + ("\n" if i % 9 == 8 else " "))
    return "".join(out).strip()


def table():
    """Small documents with every hard case: nulls, empties, ties, copies, a long text, odd white space."""
    base = prose(1, 120)
    texts = [
        base, base, base + " " + prose(2, 40), prose(3, 60), prose(4, 5), "one", "", None, "   \t\n ", "Ünï cödé tëxt 漢字 ok",
        prose(5, 70) + "\n" + "\n".join(base.split("\n")[2:6]), prose(6, 3000), "dup dup dup " * 40, "a b c d e f g", "123 456 !!", base.replace("alpha", "Alpha"), prose(3, 60),
    ]
    langs = ["en", "en", None, "de", "de", "en", "en", "en", None, "de", "en", "de", "en", "en", None, "en", "de"]
    rows = [(i * 3 - 4, t, langs[i], f"src{i % 3}" if i != 5 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows.append((None, prose(7, 50), "en", "src0", None))
    rows.append((2, "second text with an id that is taken", "en", "src0", 1))
    rows.append(rows[3])  # a repeated row
    return rows
