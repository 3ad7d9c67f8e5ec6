"""Quality rules, line first.

Every line is judged on its own (punctuation, navigation, boilerplate); failing
lines are removed, then documents that lost too much of their text are rejected.
Statistics of the whole document give a second, base verdict.

One pass over the documents without a shuffle: the work on a document needs
nothing but its text, so it scales with the input and a lost executor costs its
own partitions only.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import map_rows

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Share of a document's word characters that its failing lines may hold.
MAX_LOST = 0.5
# A line passes the punctuation rule if it ends like a sentence, a list item or
# an introduction (closing quotes and brackets may follow), or if a sentence
# ends within it: a paragraph may close with a number, a name or an address.
TERMINAL = ".!?…:;。！？।؟"
CLOSERS = "\"'”’»)]}*_"
SENTENCE_END = re.compile(r"\w[.?…。？।؟][\"'”’»)]*\s")
# Navigation: so many separators, and at most so many words between two.
SEPARATORS = re.compile(r"[|»›•·→]|\s[>/]\s")
MIN_SEPARATORS = 3
MAX_WORDS_BETWEEN = 4
# Boilerplate: one of these phrases in a line of at most so many words.
BOILERPLATE = re.compile(
    r"\b(?:(?:privacy|cookie) policy|terms (?:of (?:use|service)|and conditions)|all rights reserved|"
    r"(?:enable|requires?) javascript|accept (?:all )?cookies|we use cookies|lorem ipsum|"
    r"(?:sign|log) ?(?:in|up|out) (?:to|for|with)|subscribe to our|share (?:this )?on|follow us on|"
    r"click here|read more|back to top|skip to (?:main )?content|powered by)\b", re.IGNORECASE)
MAX_BOILERPLATE_WORDS = 25
# Noise: a line in which so large a share of the words carries a symbol run,
# shouts or repeats the word before it is no prose.
NOISY_WORD = re.compile(r"([#*$%&<>=~^@])\1\1|!!")
MAX_NOISY = 0.5

LINE_RULES = ("punctuation", "navigation", "boilerplate", "noise")


def line_failure(line: str) -> str | None:
    """The first rule that ``line`` fails, else None.  Blank lines pass."""
    bare = line.strip()
    if not bare:
        return None
    words = bare.split()
    if len(SEPARATORS.findall(bare)) >= MIN_SEPARATORS:
        parts = [len(p.split()) for p in SEPARATORS.split(bare)]
        if sum(parts) <= MAX_WORDS_BETWEEN * len(parts):
            return "navigation"
    if len(words) <= MAX_BOILERPLATE_WORDS and BOILERPLATE.search(bare):
        return "boilerplate"
    if sum(1 for w, before in zip(words, ["", *words]) if w == before or NOISY_WORD.search(w)) > MAX_NOISY * len(words):
        return "noise"
    if not bare.rstrip(CLOSERS).endswith(tuple(TERMINAL)) and not SENTENCE_END.search(bare):
        return "punctuation"
    return None


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    word_chars = len(b"".join(words).decode("utf-8", "replace"))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            if line in seen:
                dup += 1
            seen.add(line)
    windows = [b" ".join(words[i:i + REPEAT_WINDOW]) for i in range(len(words) - REPEAT_WINDOW + 1)]
    repeated = 0
    if len(set(windows)) < len(windows):
        times, covered = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + REPEAT_WINDOW - max(i, covered)
                covered = i + REPEAT_WINDOW
    return len(words), word_chars, n_symbols, dup, repeated


def judge(text: bytes | None, max_lost: float = MAX_LOST):
    """Counts, failing lines by rule, cleaned text and verdict of one document."""
    text = text or b""
    n_words, word_chars, n_symbols, dup, repeated = base_counts(text)
    base_failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n_words
    kept, lost, fails = [], 0, Counter()
    for line in text.decode("utf-8", "replace").split("\n"):
        rule = line_failure(line)
        if rule is None:
            kept.append(line)
        else:
            fails[rule] += 1
            lost += len("".join(line.encode().decode().split()))
    share = min(1.0, lost / word_chars) if word_chars else 0.0
    return (n_words, word_chars, n_symbols, dup, repeated, base_failed, not base_failed and share <= max_lost,
            share, *(fails[r] for r in LINE_RULES), "\n".join(kept))


OUTPUT = [("n_words", "long", pa.int64()), ("word_chars", "long", pa.int64()), ("n_symbols", "long", pa.int64()),
          ("n_dup_lines", "long", pa.int64()), ("n_repeat_words", "long", pa.int64()),
          ("base_failed", "boolean", pa.bool_()), ("kept", "boolean", pa.bool_()),
          ("lost_share", "double", pa.float64()),
          *[(f"n_{r}_lines", "long", pa.int64()) for r in LINE_RULES], ("clean_text", "string", pa.string())]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_lost: float = MAX_LOST, with_text: bool = True) -> DataFrame:
    """Judge every document; one output row for each input row.

    Columns: ``doc_id``, the base counts, ``base_failed``, ``kept``,
    ``lost_share`` (share of word characters in failing lines), a count of
    failing lines for each rule and ``clean_text`` (the lines that pass).

    Null text is empty text: no words, ``base_failed``.  Null ids are kept.
    Repeated rows give repeated results, an empty table an empty result, and
    other columns of the input are ignored whatever their names.
    """
    out = OUTPUT if with_text else OUTPUT[:-1]
    arrow = pa.schema([("doc_id", pa.int64()), *[(n, a) for n, _, a in out]])
    schema = ", ".join(["doc_id long", *[f"{n} {s}" for n, s, _ in out]])
    width = len(out)

    def row(doc_id, text):
        return (doc_id, *judge(text, max_lost)[:width])

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")),
                    row, schema, arrow)
