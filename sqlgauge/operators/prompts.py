"""Prompt-set building (E1-E5): examples x strategies x schema text, one job.

A strategy builds three Columns (system, user, max_tokens) from the question
and the two schema texts.  The built-in strategies are text templates with
``{question}``, ``{schema_min}`` and ``{schema_full}`` slots; any Column
builder can be registered under a new name.  An unknown name raises
KeyError, like a dict lookup.  Examples x strategies is a union of one
projection per strategy (no cross join); schema texts (one row per
database) are joined by ``db_id``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.functions import text

DEFAULT_MAX_TOKENS = 512
COT_MAX_TOKENS = 900
DIALECT = "Spark SQL"

_ROLE = (f"Act as the query desk of a data team that runs {DIALECT}. Each request brings a catalog "
         "extract; names outside it do not exist.")
SYSTEM = _ROLE + " Reply with a runnable statement only, since the reply is executed as it stands."
SYSTEM_COT = _ROLE + (" Reason on paper first. Only the fenced block marked sql at the end of the reply "
                      "is executed.")
# Two solved requests on invented tables, for the few-shot strategy.
FEW_SHOT_EXAMPLES = [
    ("What did the heaviest parcel of each depot weigh?",
     "SELECT depot_id, max(weight_kg) FROM parcel GROUP BY depot_id"),
    ("Depots that sent nothing in 2021?",
     "SELECT d.town FROM depot d LEFT ANTI JOIN parcel p ON p.depot_id = d.depot_id AND year(p.sent_on) = 2021"),
]
SLOTS = ("question", "schema_min", "schema_full")


@dataclass(frozen=True)
class Template:
    """A prompt strategy as text with slots; renders in Spark or in SQL."""

    system: str
    user: str
    max_tokens: int | None = None

    def parts(self) -> list[tuple[bool, str]]:
        """(is_slot, text) pieces of the user template, in order."""
        return text.parts(self.user)

    def __call__(self, q: Column, minimal: Column, full: Column):
        user = text.render(self.user, question=q, schema_min=minimal, schema_full=full)
        mx = F.lit(self.max_tokens) if self.max_tokens else F.lit(None).cast("int")
        return F.lit(self.system), user, mx


_SHOTS = "\n\n".join(f"Request: {a}\nStatement: {b}" for a, b in FEW_SHOT_EXAMPLES)

Builder = Callable[[Column, Column, Column], tuple[Column, Column, Column]]

STRATEGIES: dict[str, Builder] = {
    "zero_shot": Template(
        SYSTEM, "Request: {question}\n\nCatalog (names only):\n{schema_min}\n\nStatement:"),
    "schema_aware": Template(
        SYSTEM, "Request: {question}\n\nCatalog (declarations and sample rows):\n{schema_full}\n\nStatement:"),
    "few_shot": Template(
        SYSTEM, "Earlier requests, on another catalog:\n\n" + _SHOTS
                + "\n\nCatalog of the next request:\n{schema_full}\n\nRequest: {question}\nStatement:"),
    "chain_of_thought": Template(
        SYSTEM_COT, "Request: {question}\n\nCatalog (declarations and sample rows):\n{schema_full}\n\n"
                    "On paper: 1. columns that the answer shows; 2. tables that hold them and how rows pair up; "
                    "3. conditions; 4. grouping and order. Then the sql block.",
        COT_MAX_TOKENS),
}


# Schema texts are broadcast to the examples only below this many characters.
BROADCAST_TEXT_LIMIT = 64 * 1024 * 1024


def _maybe_broadcast(texts: DataFrame) -> DataFrame:
    """Broadcast the per-database texts when their measured size allows."""
    size = texts.agg(F.coalesce(F.sum(F.length("schema_text") + F.length("schema_text_min")),
                                F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(texts) if size <= BROADCAST_TEXT_LIMIT else texts


def register_strategy(name: str, builder: Builder) -> None:
    STRATEGIES[name] = builder


def build_prompts(examples: DataFrame, schema_texts: DataFrame,
                  strategies: list[str] | None = None) -> DataFrame:
    """examples' columns + strategy, system, user, max_tokens.

    ``examples``: example_id, db_id, question (+ any extra columns, kept).
    ``schema_texts``: db_id, schema_text, schema_text_min (one row per
    database); broadcast when their total size is under the limit, else
    joined by shuffle.
    """
    names = strategies or list(STRATEGIES)
    builders = [(n, STRATEGIES[n]) for n in names]  # KeyError on unknown names
    base = examples.join(_maybe_broadcast(schema_texts), "db_id", "left")
    q = F.col("question")
    mn = F.coalesce(F.col("schema_text_min"), F.lit(""))
    full = F.coalesce(F.col("schema_text"), F.lit(""))
    parts = []
    for name, b in builders:
        system, user, mx = b(q, mn, full)
        parts.append(base.select(*examples.columns, F.lit(name).alias("strategy"),
                                 system.alias("system"), user.alias("user"),
                                 F.coalesce(mx, F.lit(DEFAULT_MAX_TOKENS)).alias("max_tokens")))
    return reduce(DataFrame.unionByName, parts)


def question_vectors(df: DataFrame, id_col: str, dims: int = 512) -> DataFrame:
    """(id, vec): hashed word counts of ``question``."""
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    text_df = df.select(F.col(id_col).alias("id"), F.coalesce("question", F.lit("")).alias("question"))
    words = RegexTokenizer(inputCol="question", outputCol="words", pattern="[^\\p{L}\\p{N}]+").transform(text_df)
    hashed = HashingTF(inputCol="words", outputCol="tf", numFeatures=dims).transform(words)
    return hashed.select("id", vector_to_array("tf").alias("vec"))


def similar_shots(examples: DataFrame, solved: DataFrame, k: int = 2) -> DataFrame:
    """(example_id, shots): the ``k`` solved examples whose questions are most alike.

    ``solved``: example_id, question, gold_sql.  An example is never its own shot;
    one without any shot has an empty text.
    """
    from sqlgauge.operators.extend import top_k_similar
    hits = top_k_similar(
        question_vectors(examples, "example_id").toDF("example_id", "qvec"),
        question_vectors(solved, "example_id").toDF("shot_id", "cvec"), k=k + 1,
        query_id="example_id", query_vec="qvec", corpus_id="shot_id", corpus_vec="cvec")
    texts = solved.select(F.col("example_id").alias("shot_id"), F.concat(
        F.lit("Request: "), F.col("question"), F.lit("\nStatement: "), F.col("gold_sql")).alias("shot"))
    found = (hits.where("example_id <> shot_id").join(texts, "shot_id").groupBy("example_id")
             .agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "shot"))), 1, k).alias("s")))
    return (examples.select("example_id").join(found, "example_id", "left")
            .select("example_id", F.coalesce(F.array_join(F.col("s.shot"), "\n\n"), F.lit("")).alias("shots")))


def build_similar_prompts(examples: DataFrame, schema_texts: DataFrame, solved: DataFrame,
                          k: int = 2) -> DataFrame:
    """Prompts like ``build_prompts``, strategy ``similar_shot``: shots chosen per question."""
    base = (examples.join(_maybe_broadcast(schema_texts), "db_id", "left")
            .join(similar_shots(examples, solved, k), "example_id"))
    user = F.concat(F.lit("Earlier requests, on other data:\n\n"), F.col("shots"),
                    F.lit("\n\nCatalog of the next request:\n"), F.coalesce("schema_text", F.lit("")),
                    F.lit("\n\nRequest: "), F.col("question"), F.lit("\nStatement:"))
    return base.select(*examples.columns, F.lit("similar_shot").alias("strategy"), F.lit(SYSTEM).alias("system"),
                       user.alias("user"), F.lit(DEFAULT_MAX_TOKENS).alias("max_tokens"))
