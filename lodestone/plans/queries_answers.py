"""Answer metrics, text overlap and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import has_answer, normalize_answer
from ..operators import answers, runlog
from .registry import QA, normalized, qa_pairs, query, tok, with_, word_list


def contains_sql(text: str, word: str) -> str:
    run = f"chr(1) || array_to_string({tok(f'lower({word})')}, chr(1)) || chr(1)"
    return f"contains(chr(1) || array_to_string({tok(f'lower({text})')}, chr(1)) || chr(1), {run})"


@query("normalize_answer", f"SELECT doc_id, {normalized('text')} AS answer FROM documents")
def normalize_answer_query(t):
    return t.documents.select("doc_id", normalize_answer(F.col("text")).alias("answer"))


@query(
    "context_hits",
    rf"""SELECT doc_id, i - 1 AS pos, {contains_sql('line', "'the'")} OR {contains_sql('line', "'de la'")} AS hit
      FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS line,
            generate_subscripts(string_split(text, E'\n'), 1) AS i FROM documents)""",
)
def context_hits(t):
    """Every line of a document as a retrieved text."""
    rows = t.documents.select(
        "doc_id",
        F.split("text", "\n").alias("ctxs"),
        F.array(F.lit("The"), F.lit("de  la")).alias("answers"),
    )
    return answers.context_hits(rows, ["doc_id"], "ctxs", "answers")


LANG_ANSWER = "CASE lang WHEN 'en' THEN 'of the' WHEN 'fr' THEN 'le' WHEN 'de' THEN 'der' ELSE 'y de' END"


@query(
    "substring_match",
    f"""SELECT round(avg(({contains_sql('text', LANG_ANSWER)})::INT), 6) AS substring_match FROM documents""",
)
def substring_match(t):
    answer = (
        F.when(F.col("lang") == "en", "Of the")
        .when(F.col("lang") == "fr", "le")
        .when(F.col("lang") == "de", "DER")
        .otherwise("y de")
    )
    hit = has_answer(answers.as_list(answer), F.col("text"))
    return answers.score(t.documents, hit, "substring_match")


PREDICTION = "CASE WHEN quality = 1 THEN 'The  ' || upper(source) || '!' ELSE lang END"


@query(
    "exact_match",
    f"""SELECT round(avg(({normalized(PREDICTION)} = {normalized('source')})::INT), 6) AS exact_match
      FROM documents JOIN labels USING (doc_id)""",
)
def exact_match(t):
    rows = t.documents.join(t.labels, "doc_id")
    said = F.when(
        F.col("quality") == 1, F.concat(F.lit("The  "), F.upper("source"), F.lit("!"))
    ).otherwise(F.col("lang"))
    return answers.score(rows, answers.exact_match(said, F.array("source", F.lit("nothing"))), "exact_match")


def f1_sql(split: str, rounded: bool = True) -> str:
    """Best multiset F1 of ``answer`` against the question and against the whole talk."""
    return with_(
        qa=QA,
        g=rf"SELECT key, answer, unnest([question, question || E'\n' || answer]) AS gold, unnest([0, 1]) AS a FROM qa",
        l=f"SELECT key, a, unnest({split.format(x=normalized('answer'))}) AS t FROM g",
        r=f"SELECT key, a, unnest({split.format(x=normalized('gold'))}) AS t FROM g",
        lc="SELECT key, a, t, count(*) AS n FROM l GROUP BY ALL",
        rc="SELECT key, a, t, count(*) AS n FROM r GROUP BY ALL",
        ln="SELECT key, a, sum(n) AS n FROM lc GROUP BY ALL",
        rn="SELECT key, a, sum(n) AS n FROM rc GROUP BY ALL",
        c="SELECT key, a, sum(least(lc.n, rc.n))::DOUBLE AS n FROM lc JOIN rc USING (key, a, t) GROUP BY ALL",
        f="""SELECT key, a, CASE WHEN c.n IS NULL THEN 0 ELSE 2 * (c.n / ln.n) * (c.n / rn.n) / (c.n / ln.n + c.n / rn.n) END AS f1
             FROM g LEFT JOIN c USING (key, a) LEFT JOIN ln USING (key, a) LEFT JOIN rn USING (key, a)""",
    ) + f"SELECT key, {'round(max(f1), 6)' if rounded else 'max(f1)'} AS f1 FROM f GROUP BY key"


def predicted(t):
    """(key, prediction, answers): replies against the question and the whole talk."""
    return qa_pairs(t).select(
        "key",
        F.col("answer").alias("prediction"),
        F.array("question", F.concat_ws("\n", "question", "answer")).alias("answers"),
    )


@query("token_f1", f1_sql(word_list("{x}")))
def token_f1(t):
    return answers.token_f1(predicted(t), "key", "prediction", "answers")


@query("char_f1", f1_sql("list_filter(string_split({x}, ''), lambda w: w <> '')"))
def char_f1(t):
    return answers.char_f1(predicted(t), "key", "prediction", "answers")


# Longest common subsequence row by row: a row is the running maximum of "carry
# over" and "extend the diagonal", for all pairs at once.
GOLDS = rf"""
  SELECT key, answer, unnest([question, question || E'\n' || answer]) AS gold, unnest([0, 1]) AS a FROM qa"""
LCS = {
    "qa": QA,
    "g": GOLDS,
    "l": f"""SELECT key, a, unnest(w) AS t, generate_subscripts(w, 1) AS i
             FROM (SELECT key, a, {word_list('answer')} AS w FROM g)""",
    "r": f"""SELECT key, a, unnest(w) AS t, generate_subscripts(w, 1) AS j
             FROM (SELECT key, a, {word_list('gold')} AS w FROM g)""",
    "dp": """
      SELECT key, a, 0 AS i, j, 0 AS v FROM r
      UNION ALL
      SELECT key, a, i, j, max(c) OVER (PARTITION BY key, a ORDER BY j) AS v FROM (
        SELECT d.key, d.a, l.i, d.j,
          greatest(d.v, CASE WHEN l.t = r.t THEN 1 + coalesce(d.before, 0) ELSE 0 END) AS c
        FROM (SELECT *, lag(v) OVER (PARTITION BY key, a ORDER BY j) AS before FROM dp) d
        JOIN l ON l.key = d.key AND l.a = d.a AND l.i = d.i + 1
        JOIN r ON r.key = d.key AND r.a = d.a AND r.j = d.j)""",
    "n": "SELECT key, a, max(v)::DOUBLE AS common, max(i) AS nl, max(j) AS nr FROM dp GROUP BY ALL",
    "rl": """SELECT key, max(CASE WHEN common = 0 THEN 0
             ELSE 2 * (common / nl) * (common / nr) / (common / nl + common / nr) END) AS rl FROM n GROUP BY key""",
}


@query("rouge_l", "WITH RECURSIVE " + with_(**LCS)[5:] + "SELECT key, round(rl, 6) AS rouge_l FROM rl")
def rouge_l(t):
    rows = predicted(t)
    return rows.select("key", answers.rouge_l(F.col("prediction"), F.col("answers")).alias("rouge_l"))


@query(
    "truthful_scores",
    "WITH RECURSIVE "
    + with_(**LCS, best_f1=f1_sql(word_list("{x}"), rounded=False))[5:]
    + "SELECT round(avg(f1), 6) AS f1, round(avg(rl), 6) AS rl FROM rl JOIN best_f1 USING (key)",
)
def truthful_scores(t):
    return answers.truthful_scores(predicted(t), "key", "prediction", "answers")


@query(
    "fact_check_acc",
    """SELECT round(avg((CASE WHEN quality = 1 THEN list_has_any(k, ['supports', 'yes', 'true'])
      ELSE list_has_any(k, ['refutes', 'no', 'false']) END)::INT), 6) AS fact_checking_acc
      FROM (SELECT quality, """
    + tok("lower(text || CASE WHEN toxic = 1 THEN ' No.' ELSE ' Yes, TRUE' END)")
    + """ AS k FROM documents JOIN labels USING (doc_id))""",
)
def fact_check_acc(t):
    rows = t.documents.join(t.labels, "doc_id")
    said = F.concat("text", F.when(F.col("toxic") == 1, " No.").otherwise(" Yes, TRUE"))
    verdict = F.when(F.col("quality") == 1, "True").otherwise("False")
    hit = has_answer(answers.verdict_answers(verdict), said)
    return answers.score(rows, hit, "fact_checking_acc")


JOINED = "question || ' || ' || answer"


@query(
    "output_recall",
    with_(qa=QA)
    + f"""SELECT round(avg(({contains_sql(JOINED, "'the'")} OR {contains_sql(JOINED, "'de la'")})::INT), 6) AS recall,
      round(avg(len({word_list(JOINED)})), 6) AS mean_words FROM qa WHERE turn > 0""",
)
def output_recall(t):
    """Lines of an output file; the opening turn of a talk plays the header line."""
    rows = qa_pairs(t).select(
        (F.col("turn") == 0).alias("header"), F.array("question", "answer").alias("output")
    )
    joined = rows.filter(~F.col("header")).select(F.array_join("output", " || ").alias("text"))
    hit = has_answer(F.array(F.lit("the"), F.lit("de la")), F.col("text"))
    return joined.agg(
        F.avg(hit.cast("double")).alias("recall"), answers.mean_words(F.col("text")).alias("mean_words")
    )


@query(
    "multiple_choice_acc",
    """SELECT round(avg((CASE WHEN quality = 1 THEN 'A' ELSE 'B' END = CASE WHEN toxic = 1 THEN 'B' ELSE 'A' END)::INT), 6)
      AS accuracy FROM labels""",
)
def multiple_choice_acc(t):
    said = F.when(F.col("quality") == 1, "A").otherwise("B")
    true = F.when(F.col("toxic") == 1, "B").otherwise("A")
    return answers.score(t.labels, said == true, "accuracy")


# --- n-gram overlap -----------------------------------------------------------------------


def grams_sql(x: str, n: int) -> str:
    return f"list_transform(range(1, len({x}) - {n} + 2), lambda i: array_to_string({x}[i : i + {n - 1}], chr(1)))"


def overlap_sql(orders: list[int], lower: bool) -> dict[str, str]:
    wrap = (lambda c: f"lower({c})") if lower else (lambda c: c)
    every = " UNION ALL ".join(
        f"SELECT key, {n} AS n, {grams_sql('l', n)} AS lg, {grams_sql('r', n)} AS rg FROM k" for n in orders
    )
    return {
        "qa": QA,
        "k": f"SELECT key, {tok(wrap('answer'))} AS l, {tok(wrap('question'))} AS r FROM qa",
        "g": every,
        "lc": "SELECT key, n, t, count(*) AS c FROM (SELECT key, n, unnest(lg) AS t FROM g) GROUP BY ALL",
        "rc": "SELECT key, n, t, count(*) AS c FROM (SELECT key, n, unnest(rg) AS t FROM g) GROUP BY ALL",
        "m": "SELECT key, n, sum(least(lc.c, rc.c))::DOUBLE AS c FROM lc JOIN rc USING (key, n, t) GROUP BY ALL",
    }


@query(
    "corpus_bleu",
    with_(
        **overlap_sql([1, 2, 3, 4], lower=False),
        s="""SELECT n, (SELECT coalesce(sum(c), 0) FROM m WHERE m.n = g.n) AS hits, sum(len(lg))::DOUBLE AS total,
             sum(len(rg))::DOUBLE AS wanted FROM g GROUP BY n""",
        z="SELECT *, sum((hits = 0)::INT) OVER (ORDER BY n) AS zeros FROM s",
        b="SELECT least(1, exp(1 - wanted / total)) AS brevity FROM s WHERE n = 1",
        l="SELECT exp(avg(ln(CASE WHEN hits = 0 THEN pow(2, -zeros) ELSE hits END / total))) AS x FROM z",
    )
    + """SELECT round(100 * (SELECT brevity FROM b) * (SELECT x FROM l), 6) AS bleu,
      round((SELECT brevity FROM b), 6) AS brevity, """
    + ", ".join(f"max(hits) FILTER (n = {n})::BIGINT AS matches_{n}" for n in range(1, 5))
    + ", "
    + ", ".join(f"max(total) FILTER (n = {n})::BIGINT AS ngrams_{n}" for n in range(1, 5))
    + " FROM s",
)
def corpus_bleu(t):
    return answers.corpus_bleu(qa_pairs(t), "key", "answer", "question")


@query(
    "rouge_n",
    with_(
        **overlap_sql([1, 2], lower=True),
        f="""SELECT g.n, CASE WHEN m.c IS NULL THEN 0 ELSE 2 * (m.c / len(lg)) * (m.c / len(rg)) / (m.c / len(lg) + m.c / len(rg)) END AS f
             FROM g LEFT JOIN m USING (key, n)""",
    )
    + "SELECT n::BIGINT AS n, round(avg(f), 6) AS rouge FROM f GROUP BY ALL",
)
def rouge_n(t):
    pairs = qa_pairs(t)
    one, two = (
        answers.rouge_n(pairs, "key", "answer", "question", n).agg(F.avg("f").alias("rouge")).withColumn("n", F.lit(n))
        for n in (1, 2)
    )
    return one.unionByName(two)


def line_tokens(text: str) -> str:
    """(key, s, i, t): the tokens of every line of a text."""
    lines = rf"""SELECT key, unnest(string_split({text}, E'\n')) AS line,
      generate_subscripts(string_split({text}, E'\n'), 1) AS s FROM qa"""
    return f"""SELECT key, s, unnest(w) AS t, generate_subscripts(w, 1) AS i
      FROM (SELECT key, s, {tok('lower(line)')} AS w FROM ({lines}))"""


# Rows of lengths for every reference line (u) and predicted line (s), then a walk
# back from the last cell of each pair: along the diagonal where the tokens agree, else to
# the longer of the two neighbours.
LSUM = f"""WITH RECURSIVE qa AS ({QA}),
  l AS MATERIALIZED ({line_tokens('answer')}),
  r AS MATERIALIZED ({line_tokens('question')}),
  dp AS (
    SELECT r.key, r.s AS u, p.s, 0 AS j, r.i, 0 AS v FROM r JOIN (SELECT DISTINCT key, s FROM l) p USING (key)
    UNION ALL
    SELECT key, u, s, j, i, max(c) OVER (PARTITION BY key, u, s ORDER BY i) AS v FROM (
      SELECT d.key, d.u, d.s, l.i AS j, d.i,
        greatest(d.v, CASE WHEN l.t = r.t THEN 1 + coalesce(d.before, 0) ELSE 0 END) AS c
      FROM (SELECT *, lag(v) OVER (PARTITION BY key, u, s ORDER BY i) AS before FROM dp) d
      JOIN l ON l.key = d.key AND l.s = d.s AND l.i = d.j + 1
      JOIN r ON r.key = d.key AND r.s = d.u AND r.i = d.i)),
  moves AS MATERIALIZED (
    SELECT d.key, d.u, d.s, d.i, d.j, l.t = r.t AS hit, above > coalesce(beside, 0) AS up FROM (
      SELECT *, lag(v) OVER (PARTITION BY key, u, s, i ORDER BY j) AS above,
        lag(v) OVER (PARTITION BY key, u, s, j ORDER BY i) AS beside FROM dp) d
    JOIN l ON l.key = d.key AND l.s = d.s AND l.i = d.j
    JOIN r ON r.key = d.key AND r.s = d.u AND r.i = d.i),
  walk AS (
    SELECT m.* FROM moves m JOIN (SELECT key, u, s, max(i) AS i, max(j) AS j FROM moves GROUP BY ALL) USING (key, u, s, i, j)
    UNION ALL
    SELECT m.* FROM walk w JOIN moves m ON m.key = w.key AND m.u = w.u AND m.s = w.s
      AND m.i = w.i - (w.hit OR NOT w.up)::INT AND m.j = w.j - (w.hit OR w.up)::INT),
  hits AS (
    SELECT key, t, count(*) AS n FROM (SELECT DISTINCT key, u, i FROM walk WHERE hit) w
    JOIN (SELECT key, s AS u, i, t FROM r) USING (key, u, i) GROUP BY ALL),
  lc AS (SELECT key, t, count(*) AS n FROM l GROUP BY ALL),
  c AS (SELECT key, sum(least(hits.n, lc.n))::DOUBLE AS common FROM hits JOIN lc USING (key, t) GROUP BY key),
  n AS (SELECT key, (SELECT count(*) FROM l WHERE l.key = qa.key) AS nl, (SELECT count(*) FROM r WHERE r.key = qa.key) AS nr FROM qa)
SELECT key, round(CASE WHEN common IS NULL THEN 0
  ELSE 2 * (common / nl) * (common / nr) / (common / nl + common / nr) END, 6) AS rouge_lsum FROM n LEFT JOIN c USING (key)"""


@query("rouge_lsum", LSUM)
def rouge_lsum(t):
    pairs = qa_pairs(t)
    return pairs.select("key", answers.rouge_lsum(F.col("answer"), F.col("question")).alias("rouge_lsum"))


# --- run logs ----------------------------------------------------------------------------------


@query("perplexity", "SELECT round(exp(avg(value / 50.0::DOUBLE)), 6) AS perplexity FROM events")
def perplexity(t):
    return runlog.perplexity(t.events, F.col("value") / 50.0)


@query(
    "rolling_loss",
    """SELECT event_id, user_id, round(avg(ln(1 + value)) OVER (PARTITION BY user_id ORDER BY event_id
      ROWS UNBOUNDED PRECEDING), 6) AS rolling_loss, round(avg(ln(1 + value)) OVER (PARTITION BY user_id
      ORDER BY event_id ROWS 19 PRECEDING), 6) AS window_loss FROM events""",
)
def rolling_loss(t):
    log = t.events.select("event_id", "user_id", F.log1p("value").alias("loss"))
    return runlog.rolling_loss(log, "user_id", "event_id", "loss", 20, bits=10).drop("loss")


@query(
    "best_so_far",
    """SELECT event_id, user_id, max(value) OVER w AS best,
      coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), true) AS improved FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def best_so_far(t):
    log = t.events.select("event_id", "user_id", "value")
    return runlog.best_so_far(log, "user_id", "event_id", "value", bits=10).drop("value")


@query(
    "best_checkpoint",
    """SELECT user_id, event_id, value FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1""",
)
def best_checkpoint(t):
    return runlog.best_checkpoint(t.events, "user_id", "event_id", "value")
