"""Prompts and targets from templates that are data (PRJ02).

A template is a string with places ``{field}`` or ``{field|rule}``; it stands in a row of its task,
and so do the words that stand for classes.  ``fill`` reads the template of each row as Column
expressions: the text between the places and the values of the places are put together in
order.  A new task is a new row, not a new function; the plan is the same for any number of them.

Rules: ``classes`` looks the value up among the task's words; ``question`` adds a question mark
where there is none; ``first`` takes the first entry of a JSON list.

Defined cases: a field that the row doesn't have, a null value and a class without a word give a
null text (nothing is made up); a template without places is its own text; braces that hold no
name stay as they are; a task without a template row gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checked_broadcast
from .text import col, let

PLACE = r"\{([\p{L}_][\p{L}\p{N}_]*(?:\|[a-z]+)?)\}"

# Prompt and target templates of the task families, as the models are asked.
TEMPLATES = {
    "news_topic": ("Título: {title}\nTexto: {text}\nCategoria:", " {label|classes}"),
    "entailment": ('Pergunta: Dado que "{premise}", é verdade que "{hypothesis}"?\nResposta:', " {label|classes}"),
    "similarity": ("Sentença 1: {premise}\nSentença 2: {hypothesis}\nResposta:", " {score}"),
    "yes_no_passage": ("Pergunta: {question}\nContexto: {passage}\nResposta:", " {label|classes}"),
    "reading": ("Contexto: {context}\nPergunta: {question}\nResposta:", " {answers|first}"),
    "offensive_comment": ('Mensagem: "{text}".\nResposta:', " {label|classes}"),
    "hate_class": ('Mensagem: "{text}".\nClassificação:', " {label|classes}"),
    "hate_message": ('Mensagem: "{text}".\nResposta:', " {target}"),
    "review": ("Crítica: {text}\nAvaliação:", " {label|classes}"),
    "message_sentiment": ('Mensagem: "{text}".\nResposta:', " {label|classes}"),
    "command": ("Comando: {text}\nCategoria:", " {label|classes}"),
    "open_question": ("Pergunta: {query|question}\nResposta:", " {answer|classes}"),
    "story_ending": ("Passagem 1: {sentence_1}\nPassagem 2: {sentence_2}\nPassagem 3: {sentence_3}\nPassagem 4: {sentence_4}\nDesfecho 1: {ending_1}\nDesfecho 2: {ending_2}\nResposta:", " {right}"),
    "pronoun_completion": ("{before}", "{after}"),
    "pronoun_choice": ("{before}\nA.{first}\nB.{second}\nResposta:", " {letter}."),
}

# Words of the classes, by the value in the data.
CLASSES = {
    "news_topic": {"0": "Mundo", "1": "Esportes", "2": "Negócios", "3": "Tecnologia"},
    "entailment": {"0": "Não", "1": "Sim"},
    "yes_no_passage": {"0": "não", "1": "sim"},
    "offensive_comment": {"true": "ofensiva", "false": "inofensiva"},
    "hate_class": {"fatphobia": "gordofobia", "homophobia": "homofobia", "religious_intolerance": "intolerância religiosa", "sexism": "sexismo",
                   "offensive_&_non-hate_speech": "somente ofensivo", "apology_for_the_dictatorship": "apologia à ditadura", "antisemitism": "antissemitismo",
                   "xenophobia": "xenofobia", "partyism": "partidarismo", "racism": "racismo", "non-offensive": "não ofensivo"},
    "review": {"0": "negativa", "1": "positiva"},
    "message_sentiment": {"0": "negativa", "1": "neutra", "2": "positiva"},
    "command": {"general": "geral", "datetime": "data/hora", "recommendation": "recomendação", "takeaway": "entrega", "audio": "áudio", "calendar": "calendário",
                "transport": "transporte", "lists": "listas", "weather": "clima", "iot": "IoT", "play": "tocar/jogar", "cooking": "culinária", "social": "social",
                "email": "email", "qa": "perguntas e respostas", "alarm": "alarme", "news": "notícias", "music": "música"},
    "open_question": {"yes": "sim", "no": "não", "*": "{}"},
}


def template_rows(spark: SparkSession, templates: dict | None = None, classes: dict | None = None) -> DataFrame:
    """(task, prompt_template, target_template, classes): one row per task."""
    templates, classes = TEMPLATES if templates is None else templates, CLASSES if classes is None else classes
    return spark.createDataFrame([(t, p, a, classes.get(t, {})) for t, (p, a) in templates.items()],
                                 "task string, prompt_template string, target_template string, classes map<string,string>")


def _value(place: Column, fields: Column, classes: Column) -> Column:
    name, rule = F.split_part(place, F.lit("|"), F.lit(1)), F.split_part(place, F.lit("|"), F.lit(2))
    raw = F.try_element_at(fields, name)
    return let(raw, lambda v: F.when(rule == "", v)
               .when(rule == "classes", F.coalesce(F.try_element_at(classes, v), F.when(F.try_element_at(classes, F.lit("*")).isNotNull(), v)))
               .when(rule == "question", F.when(v.endswith("?"), v).otherwise(F.concat(v, F.lit("?"))))
               .when(rule == "first", F.get(F.from_json(v, "array<string>"), 0)))


def fill(template, fields, classes) -> Column:
    """The template with its places filled from ``fields`` (map<string,string>)."""
    t, f, c = col(template), col(fields), col(classes)
    between = F.split(t, PLACE, -1)
    places = F.transform(F.regexp_extract_all(t, F.lit(PLACE), F.lit(1)), lambda p: _value(p, f, c))
    # A null value makes the whole text null: concat of the pieces, not array_join.
    filled = F.aggregate(F.arrays_zip(F.slice(between, 2, F.greatest(F.size(between) - 1, F.lit(0))).alias("b"), places.alias("v")), F.get(between, 0),
                         lambda acc, x: F.concat(acc, x["v"], x["b"]))
    return F.when(t.isNotNull(), filled)


def build_prompts(items: DataFrame, templates: DataFrame, task: str = "task", fields: str = "fields") -> DataFrame:
    """``items`` (task, fields, …) with ``prompt`` and ``target``; the templates are one row per task,
    joined once."""
    side, _ = checked_broadcast(templates.select(F.col("task").alias(task), "prompt_template", "target_template", "classes"))
    j = items.join(side, task)
    return j.withColumn("prompt", fill("prompt_template", fields, "classes")).withColumn("target", fill("target_template", fields, "classes")).drop("prompt_template", "target_template", "classes")
