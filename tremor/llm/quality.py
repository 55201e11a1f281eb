"""Quality rules by weak supervision.

Rules look at a text's counts and vote good, bad or abstain.  Expectation-maximisation
over how often each combination of votes occurs (in the whole table) estimates each
rule's accuracy without labels; a text is kept if the posterior probability of good
quality is at least ``KEEP_AT`` and it does not fail the base rules.

Only the table of vote combinations (at most 3 ** number of rules rows) reaches the
driver.  Null and empty texts have no words and fail the base rules.  Repeated rows are
judged one by one; other columns, of any name, are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import lean, word_chunks

KEEP_AT = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"

#: (name, counts -> value, "good" if value <= first bound, "bad" if value > second bound); None: abstain.
#: Between the bounds a rule abstains.  The bounds are fixed and documented here, so that the votes do not depend on the table.
RULES = [
    ("symbols", lambda c: c["n_symbols"] / max(c["n_words"], 1), 0.02, 0.1),
    ("no letters", lambda c: c["n_other"] / max(c["word_chars"], 1), 0.06, 0.12),
    ("shouting", lambda c: c["n_upper"] / max(c["word_chars"], 1), 0.1, 0.3),
    ("exclaiming", lambda c: c["n_exclaim"] / max(c["n_words"], 1), 0.02, 0.15),
    ("same lines", lambda c: c["n_dup_lines"] / max(c["n_lines"], 1), 0.05, 0.4),
    ("same words", lambda c: c["n_repeat_words"] / max(c["n_words"], 1), 0.05, 0.2),
    ("word length", lambda c: abs(c["word_chars"] / max(c["n_words"], 1) - 6), 4, 8),
]
GOOD, BAD, ABSTAIN = 1, 2, 0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def votes_of(counts):
    """The votes of all rules as one number in base 3."""
    code = 0
    for i, (_, value, good, bad) in enumerate(RULES):
        v = value(counts)
        code += 3**i * (GOOD if v <= good else BAD if v > bad else ABSTAIN)
    return code


def repeated_words(windows, n_words, n=WINDOW):
    """How many words lie in an n-word window that occurs twice or more in the text."""
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    s = windows[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(s), dtype=bool)
    hit[1:] |= same
    hit[:-1] |= same
    mark = np.zeros(n_words + 1, dtype=np.int64)
    at = order[hit]
    np.add.at(mark, at, 1)
    np.add.at(mark, at + n, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def _tally(table, words):
    """Occurrences of bytes of a class in each text, outside gaps."""
    hit = np.zeros(len(words.data) + 1, dtype=np.uint8)  # one more, as the last text may be empty
    np.take(table.view(np.uint8), words.data, out=hit[:-1])
    hit[:-1] &= ~words.gap
    return np.add.reduceat(hit, words.offsets[:-1], dtype=np.int64)


def counts_of(texts):
    """Counts of each text (bytes, or an Arrow column), in order."""
    table = {name: np.zeros(256, dtype=bool) for name in ("char", "symbol", "upper", "exclaim", "other")}
    table["char"][[x for x in range(256) if x & 0xC0 != 0x80]] = True
    table["symbol"][list(SYMBOLS)] = True
    table["upper"][65:91] = True
    table["exclaim"][ord("!")] = True
    table["other"][[x for x in range(33, 127) if not chr(x).isalpha()]] = True
    for lo, hi, words in word_chunks(texts, fold=False):
        every = words.windows(WINDOW)
        tally = {k: _tally(v, words) for k, v in table.items()}
        for i in range(hi - lo):
            a, b = words.bounds[i], words.bounds[i + 1]
            lines = [x for x in words.texts[i].split(b"\n") if x.strip(SPACE)]
            yield {
                "n_words": int(b - a),
                "word_chars": int(tally["char"][i]),
                "n_symbols": int(tally["symbol"][i]),
                "n_dup_lines": len(lines) - len(set(lines)),
                "n_repeat_words": repeated_words(every[a : max(a, b - WINDOW + 1)], int(b - a)),
                "n_lines": len(lines),
                "n_upper": int(tally["upper"][i]),
                "n_exclaim": int(tally["exclaim"][i]),
                "n_other": int(tally["other"][i]),
            }


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts and ``votes`` for each row of documents."""

    def run(batches):
        for batch in batches:
            rows = [[c[k] for k in COUNTS] + [votes_of(c)] for c in counts_of(batch.column(1))]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(COUNTS) + 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], ["doc_id", *COUNTS, "votes"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in [*COUNTS, "votes"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), schema)


def fit(counts: dict[int, int], rounds: int = 300) -> tuple[float, list[list[float]]]:
    """EM over counts of vote combinations: (log odds of good, per rule its log-odds weight by vote).

    Each rule has two accuracies, where it votes: on good texts (``right``) and on bad ones
    (``caught``; bad texts are bad in different ways, and a rule sees only its own).  Both are
    drawn a little towards what all rules have together, which decides where a rule hardly votes.
    A vote for bad never speaks for good.  Starts from the votes against.  Without any rows the
    weights are those of the start.
    """
    right, caught, prior = accuracies(counts, rounds)
    weights = [[0.0, float(np.log(r / (1 - c))), float(min(0.0, np.log((1 - r) / c)))] for r, c in zip(right, caught, strict=True)]
    return float(np.log(prior / (1 - prior))), weights


def accuracies(counts: dict[int, int], rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """(per rule its accuracy on good texts, on bad texts, share of good texts)."""
    votes = np.array([[code // 3**j % 3 for j in range(len(RULES))] for code in counts], dtype=np.int64).reshape(-1, len(RULES))
    n = np.array(list(counts.values()), dtype=float)
    good, bad = (votes == GOOD).astype(float), (votes == BAD).astype(float)
    voted = good + bad
    p = 1 / (1 + np.exp(2.0 * bad.sum(1) - 2.0))
    prior, right, caught = 0.9, np.full(len(RULES), 0.95), np.full(len(RULES), 0.3)

    def drawn(weight, hits, start):
        """The share of hits among votes, with a fiftieth of the rows (one at least) voting as all rules do."""
        together = ((weight @ hits).sum() + start) / ((weight @ voted).sum() + 1)
        own = weight.sum() / 50 + 1
        return np.clip((weight @ hits + own * together) / (weight @ voted + own), 0.002, 0.998)

    for _ in range(rounds if len(n) else 0):
        prior = float(np.clip((n * p).sum() / n.sum(), 0.05, 0.98))
        right, caught = drawn(n * p, good, 0.95), drawn(n * (1 - p), bad, 0.3)
        score = np.log(prior / (1 - prior)) + good @ np.log(right / (1 - caught)) + bad @ np.log((1 - right) / caught)
        new = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return right, caught, prior


def judge(measured: DataFrame, model: tuple[float, list[list[float]]]) -> DataFrame:
    """Adds base_failed, quality (posterior) and kept to what ``measure`` returns."""
    base, weights = model
    score = F.lit(base)
    for j, w in enumerate(weights):
        digit = F.floor(F.col("votes") / 3**j) % 3
        score = score + F.when(digit == GOOD, w[GOOD]).when(digit == BAD, w[BAD]).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = measured.withColumn("base_failed", failed).withColumn("quality", F.lit(1.0) / (F.lit(1.0) + F.exp(-score)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))


def learn(measured: DataFrame) -> tuple[float, list[list[float]]]:
    """The model from all rows; the driver sees one row per combination of votes."""
    seen = {r["votes"]: r["n"] for r in measured.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    return fit(dict(sorted(seen.items())))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, base_failed, quality and kept."""
    from .shared import cut

    measured = cut(measure(docs))
    return judge(measured, learn(measured))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns, in one further pass and no shuffle."""
    model = learn(measure(docs))
    base, weights = model
    names, text_at = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = []
            for c in counts_of(batch.column(text_at)):
                code = votes_of(c)
                score = base + sum(w[code // 3**j % 3] for j, w in enumerate(weights))
                failed = c["n_words"] < MIN_WORDS or 100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"]
                keep.append(not failed and 1 / (1 + np.exp(-score)) >= KEEP_AT)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.select(*names).mapInArrow(lean(run), docs.schema)
