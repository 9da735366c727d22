"""Conversation rendering (PRJ09-PRJ11): turns table -> prompt text / message JSON.

A conversation's turns are gathered per conversation (bounded by its number of turns)
and rendered with higher-order functions — one rendered piece per message, joined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col


@dataclass(frozen=True)
class ChatStyle:
    name: str
    kind: str                      # colon_single | colon_two | no_colon_single | new_line | chatml | llama2
    roles: tuple[str, str] = ("USER", "ASSISTANT")
    sep: str = "\n"
    sep2: str = ""
    system_template: str = "{system_message}"


# A few well-known templates in the six separator styles (public formats).
STYLES = {
    "colon_single": ChatStyle("colon_single", "colon_single", ("Human", "Assistant"), "\n### "),
    "vicuna": ChatStyle("vicuna", "colon_two", ("USER", "ASSISTANT"), " ", "</s>"),
    "no_colon": ChatStyle("no_colon", "no_colon_single", ("<|user|>", "<|assistant|>"), "\n"),
    "new_line": ChatStyle("new_line", "new_line", ("### Instruction", "### Response"), "\n\n"),
    "chatml": ChatStyle("chatml", "chatml", ("<|im_start|>user", "<|im_start|>assistant"), "<|im_end|>",
                        system_template="<|im_start|>system\n{system_message}"),
    "llama2": ChatStyle("llama2", "llama2", ("[INST]", "[/INST]"), " ", " </s><s>",
                        system_template="[INST] <<SYS>>\n{system_message}\n<</SYS>>\n\n"),
}


def _system_prompt(style: ChatStyle, system: Column) -> Column:
    pre, _, post = style.system_template.partition("{system_message}")
    return F.concat(F.lit(pre), system, F.lit(post))


def render_messages(style: ChatStyle, system: Column, messages: Column) -> Column:
    """PRJ09: ``messages`` is array<struct<role_idx:int, text:string>> in order (text null
    = the slot to generate); ``system`` the system message ('' when none)."""
    sp = _system_prompt(style, system)
    r0, r1 = style.roles
    role = lambda m: F.when(m["role_idx"] == 0, F.lit(r0)).otherwise(F.lit(r1))
    has = lambda m: m["text"].isNotNull() & (m["text"] != "")
    k = style.kind
    if k == "colon_single":
        head = F.concat(sp, F.lit(style.sep))
        piece = lambda m, i: F.when(has(m), F.concat(role(m), F.lit(": "), m["text"], F.lit(style.sep))).otherwise(
            F.concat(role(m), F.lit(":")))
    elif k == "colon_two":
        head = F.concat(sp, F.lit(style.sep))
        piece = lambda m, i: F.when(has(m), F.concat(role(m), F.lit(": "), m["text"],
                                                     F.when(i % 2 == 0, F.lit(style.sep)).otherwise(F.lit(style.sep2)))
                                    ).otherwise(F.concat(role(m), F.lit(":")))
    elif k == "no_colon_single":
        head = sp
        piece = lambda m, i: F.when(has(m), F.concat(role(m), m["text"], F.lit(style.sep))).otherwise(role(m))
    elif k == "new_line":
        head = F.when(sp == "", F.lit("")).otherwise(F.concat(sp, F.lit(style.sep)))
        piece = lambda m, i: F.when(has(m), F.concat(role(m), F.lit("\n"), m["text"], F.lit(style.sep))).otherwise(
            F.concat(role(m), F.lit("\n")))
    elif k == "chatml":
        head = F.when(sp == "", F.lit("")).otherwise(F.concat(sp, F.lit(style.sep + "\n")))
        piece = lambda m, i: F.when(has(m), F.concat(role(m), F.lit("\n"), m["text"], F.lit(style.sep + "\n"))).otherwise(
            F.concat(role(m), F.lit("\n")))
    elif k == "llama2":
        head = F.when(system != "", sp).otherwise(F.lit("[INST] "))
        tag = lambda i: F.when(i % 2 == 0, F.lit(r0)).otherwise(F.lit(r1))
        piece = lambda m, i: F.when(has(m), F.when(i == 0, F.concat(m["text"], F.lit(" "))).otherwise(
            F.concat(tag(i), F.lit(" "), m["text"], F.when(i % 2 == 0, F.lit(style.sep)).otherwise(F.lit(style.sep2))))
        ).otherwise(tag(i))
    else:
        raise ValueError(k)
    return F.concat(head, F.array_join(F.transform(messages, piece), ""))


def adapt_text_to_conversation(text) -> Column:
    """PRJ11: drop the trailing answer-cue line when the prompt ends with ':'."""
    t = col(text)
    return F.when(t.endswith(":"), F.regexp_replace(t, r"\n[^\n]*$", "")).otherwise(t)


def conversation_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                       text: str = "text", add_generation_slot: bool = True) -> DataFrame:
    """Group turns per conversation: (conv, system, messages) — system text from the
    'system' turns, messages ordered by turn with role_idx 0 = user, 1 = assistant, and
    an empty assistant slot appended for generation."""
    t = turns.select(col(conv).alias("conv"), col(turn).alias("turn"), col(role).alias("role"), col(text).alias("text"))
    g = t.groupBy("conv").agg(
        F.coalesce(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "system",
                   F.struct("turn", "text")))), lambda s: s["text"]), "\n"), F.lit("")).alias("system"),
        F.array_sort(F.collect_list(F.when(F.col("role") != "system", F.struct(
            "turn", F.when(F.col("role") == "user", 0).otherwise(1).alias("role_idx"), "text")))).alias("_m"))
    msgs = F.transform("_m", lambda s: F.struct(s["role_idx"].alias("role_idx"), s["text"].alias("text")))
    if add_generation_slot:
        msgs = F.concat(msgs, F.array(F.struct(F.lit(1).alias("role_idx"), F.lit(None).cast("string").alias("text"))))
    return g.select(F.col("conv").alias(conv), "system", msgs.alias("messages"))


def render_chat(turns: DataFrame, style: ChatStyle | str, **kw) -> DataFrame:
    """PRJ09: one prompt string per conversation."""
    st = STYLES[style] if isinstance(style, str) else style
    c = conversation_turns(turns, **kw)
    conv = kw.get("conv", "conv_id")
    return c.select(conv, render_messages(st, F.col("system"), F.col("messages")).alias("prompt"))


def chat_messages(turns: DataFrame, **kw) -> DataFrame:
    """PRJ10: API message list as JSON — system first when non-empty; message i is the
    user when i is even (kept even when empty) and the assistant when odd (dropped when
    empty)."""
    c = conversation_turns(turns, add_generation_slot=False, **kw)
    conv = kw.get("conv", "conv_id")
    items = F.filter(F.transform("messages", lambda m, i: F.when(
        i % 2 == 0, F.struct(F.lit("user").alias("role"), m["text"].alias("content"))).otherwise(
        F.when(m["text"].isNotNull(), F.struct(F.lit("assistant").alias("role"), m["text"].alias("content"))))),
        lambda x: x.isNotNull())
    sys_item = F.when(F.col("system") != "", F.array(F.struct(F.lit("system").alias("role"),
                                                               F.col("system").alias("content"))))
    allm = F.concat(F.coalesce(sys_item, F.array().cast("array<struct<role:string,content:string>>")), items)
    return c.select(conv, F.to_json(allm, {"ignoreNullFields": "false"}).alias("messages_json"), F.size(allm).cast("bigint").alias("n_messages"))


# ---------------------------------------------------------------------------
# The runner's system message and its prompt template per model family
# ({system} and {prompt} are filled in); other families get the bare prompt.
RUNNER_SYSTEM = ("You are a helpful assistant that follows instructions precisely. "
                 "Answer concisely. Do not explain your reasoning.")
FAMILY_TEMPLATES = {
    "mistral": "<s>[INST] {system}\n\n{prompt} [/INST]",
    "deepseek-r1": "<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{prompt}<|im_end|>\n<|im_start|>assistant\n<think>\n",
    "qwen": "<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{prompt}<|im_end|>\n<|im_start|>assistant\n",
    "llama3": ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{system}<|eot_id|>"
               "<|start_header_id|>user<|end_header_id|>\n\n{prompt}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"),
    "sabia": ("Abaixo está uma instrução que descreve uma tarefa. Escreva uma resposta que complete adequadamente o pedido.\n\n"
              "### Instrução:\n{system}\n\n{prompt}\n\n### Resposta:\n"),
}
# ---------------------------------------------------------------------------


def apply_family_template(prompt, family, system: str = RUNNER_SYSTEM, templates=FAMILY_TEMPLATES) -> Column:
    """PRJ09 (runner): the prompt inside its model family's template; the bare prompt for a
    family without one."""
    p, f = col(prompt), col(family)
    out = None
    for name, template in templates.items():
        before, after = template.replace("{system}", system).split("{prompt}")
        filled = F.concat(F.lit(before), p, F.lit(after))
        out = F.when(f == name, filled) if out is None else out.when(f == name, filled)
    return p if out is None else out.otherwise(p)
