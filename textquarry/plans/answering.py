"""From question texts to grounded prompts and answers, for a batch of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_image_data_url
from ..operators import answer as ops
from ..store import stored
from .engine import RetrievalEngine, RetrievalOptions

STRUCTURE_PROMPT = (
    "Split the question into JSON with the keys type (single or multiple_statements), question_text and statements "
    "(a list of objects with id and text). Copy the wording; do not solve anything. Reply with the JSON object only."
)
PICTURE_PROMPT = (
    "Copy the text of the picture in its own language, formulas and numbering included. Add nothing, solve nothing, and mark what "
    "cannot be read."
)
ANSWER_PROMPT = (
    "Explain the answer as a patient teacher, in Persian, from the supplied passages only. Judge every statement of a question "
    "that lists several. Cite the given book-and-page labels in brackets and say so when the passages do not suffice."
)


@dataclass
class AnswerModels:
    structure: str = "small"
    answer: str = "large"
    picture: str = "small"


def answer(
    questions: DataFrame, engine: RetrievalEngine, provider: ops.ChatProvider, catalog: DataFrame, history: DataFrame | None = None,
    options: RetrievalOptions | None = None, models: AnswerModels | None = None, scoped: bool = False,
) -> DataFrame:
    """(question_id, structure, error, prompt, answer) of questions (question_id, typed_text, ocr_text or image_data[, scope]).

    ``image_data`` is a picture's data URL: its text is read by a model, and the answering
    model sees the picture as well.  Other values are an error.  Replies whose structure
    is refused carry an error and get no answer.  Replies are stored as they come in, so that
    no later failure asks a paid model again.
    """
    options, models = options or RetrievalOptions(top_k=3, mode="bm25"), models or AnswerModels()
    rows, picture = questions, "image_data" if "image_data" in questions.columns else None
    wrong = F.lit(False)
    if picture:
        rows = rows if "ocr_text" not in rows.columns else rows.drop("ocr_text")
        rows = stored(ops.read_pictures(rows, provider, models.picture, PICTURE_PROMPT), "pictures")
        wrong = F.col(picture).isNotNull() & ~is_image_data_url(F.col(picture))
    text = ops.combined_text(F.col("typed_text"), F.col("ocr_text"))
    rows = rows.withColumn("combined", F.when(~wrong, text))
    rows = ops.complete_column(rows, provider, models.structure, STRUCTURE_PROMPT, "combined", "reply")
    value, error = ops.parse_structure(F.col("reply"), F.col("combined"))
    rows = rows.withColumn("error", F.when(wrong, "not a picture's data URL").when(F.col("combined").isNull(), "no question text").otherwise(error)).withColumn("structure", value)
    rows = stored(rows.drop("reply"), "structures")
    keys = ["question_id", *(["scope"] if scoped else [])]
    queries = ops.fan_out(rows.filter("error is null").select(*keys, "structure"))
    queries = queries.withColumn("qid", F.concat_ws("/", F.col("question_id").cast("string"), F.col("query_no").cast("string")))
    found = engine.context(engine.retrieve(queries.withColumnRenamed("query_text", "text"), options, scoped))
    found = ops.with_catalog_titles(found, catalog).join(queries.select("qid", "question_id", "query_no"), "qid")
    proof = ops.evidence(found, queries, "question_id")
    rows = rows.join(proof, "question_id", "left")
    rows = rows.join(history, "question_id", "left") if history is not None else rows.withColumn("history", F.lit(None).cast("string"))
    asked = ops.prompt(F.col("combined"), F.col("history"), F.col("structure"), F.col("evidence"))
    rows = rows.withColumn("prompt", F.when(F.col("error").isNull(), asked)).select("question_id", "structure", "error", "prompt", *([picture] if picture else []))
    rows = ops.complete_column(rows, provider, models.answer, ANSWER_PROMPT, "prompt", "answer", picture, temperature=0.2)
    return stored(rows.drop("image_data"), "answers")
