"""Raw model-output cleaning (CLN01-CLN05) and model tagging (PRJ12-PRJ13) as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extract import _java, py_strip
from .text import col, let

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's sanitiser, in its order).
ASSISTANT_MARKERS = ["<|im_start|>assistant", "<|start_header_id|>assistant", "### Resposta:"]
THINK_BLOCK = r"(?is)<think>.*?</think>"
CHAT_TAG_IM = r"<\|im_(start|end)\|>[\p{L}\p{N}_]*"
CHAT_TAG_ANY = r"<\|[^>]+?\|>"
LOG_LINE_PATTERNS = [
    r"llama_perf_context_print.*",
    r"llama_print_timings.*",
    r"system_info:.*",
    r"build:.*",
    r"main:.*",
    r"common_.*",
    r"llama_.*",
    r"ggml_.*",
]
ANSWER_MARKERS = ["Resposta final:", "Answer:", "\nA:"]
BASE_STOPS = ["User:", "Instruction:", "###"]
FAMILY_STOPS = {
    "qwen": ["<|im_end|>", "<|endoftext|>", "<|im_start|>"] + BASE_STOPS,
    "deepseek": ["<|im_end|>", "<|endoftext|>", "<|im_start|>"] + BASE_STOPS,
    "llama3": ["<|eot_id|>", "<|end_of_text|>", "<|start_header_id|>", "<|eom_id|>"] + BASE_STOPS,
    "llama3.1": ["<|eot_id|>", "<|end_of_text|>", "<|start_header_id|>", "<|eom_id|>"] + BASE_STOPS,
    "llama4": ["<|eot_id|>", "<|end_of_text|>", "<|start_header_id|>", "<|eom_id|>"] + BASE_STOPS,
    "sabia": ["</s>", "### Instrução:", "### Resposta:", "###"],
    "mistral": ["</s>", "[INST]", "[/INST]", "[TOOL_CALLS]"] + BASE_STOPS,
    "generic": ["</s>"] + BASE_STOPS,
}
FAMILY_ORDER = [("mistral", "mistral"), ("qwen", "qwen"), ("llama", "llama3"), ("sabia", "sabia")]
QUANT_RX = r"(Q\d(?:[_-]?[A-Z0-9]+)*)"
OOM_CODES = [137, -9, 139]
# ---------------------------------------------------------------------------


def after_last_of_first_marker(c, markers: list[str]) -> Column:
    """The first marker (list order) present wins; keep the text after its last occurrence."""
    def pick(c):
        out = None
        for m in markers:
            branch = F.substring_index(c, m, -1)
            out = F.when(F.instr(c, m) > 0, branch) if out is None else out.when(F.instr(c, m) > 0, branch)
        return out.otherwise(c)
    return let(c, pick)


def cut_at_stops(c, stops) -> Column:
    """Cut at the earliest occurrence of any (non-empty) stop string; ``stops`` is an
    array column or a Python list."""
    arr = F.array(*[F.lit(s) for s in stops]) if isinstance(stops, (list, tuple)) else col(stops)

    def pick(c):
        pos = F.array_min(F.filter(F.transform(arr, lambda t: F.when(t != "", F.call_function("instr", c, t))
                                                      .otherwise(F.lit(0))),
                                   lambda p: p > 0))
        return let(pos, lambda q: F.when(q.isNotNull(), F.substring(c, F.lit(1), q - 1)).otherwise(c))
    return let(c, pick)


def sanitize_output(raw, stops) -> Column:
    """CLN01: the reference's ordered sanitiser."""
    c = after_last_of_first_marker(raw, ASSISTANT_MARKERS)
    c = F.regexp_replace(c, THINK_BLOCK, " ")
    c = let(c, lambda x: let(F.instr(F.lower(x), "<think>"), lambda p: F.when(
        p > 0, F.substring(x, F.lit(1), p - 1)).otherwise(x)))
    c = F.regexp_replace(c, _java(CHAT_TAG_IM), " ")
    c = F.regexp_replace(c, CHAT_TAG_ANY, " ")
    for rx in LOG_LINE_PATTERNS:
        c = F.regexp_replace(c, "(?id)" + rx, "")
    c = after_last_of_first_marker(c, ANSWER_MARKERS)
    c = cut_at_stops(c, stops)
    return py_strip(c)


def truncate_at_stops(c, stops: list[str]) -> Column:
    """CLN02: for each stop in order keep the text before its first occurrence."""
    out = col(c)
    for s in stops:
        out = F.substring_index(out, s, 1)
    return out


TOKEN_RX = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def flag_loops(text, n: int) -> Column:
    """CLN03: True when, among the last 14n tokens, three equal consecutive n-token
    windows start at some i in [0, len - 3n) (the last start is not tested, as in the
    reference).  Needs at least 4n tokens."""
    return flag_loops_all(text, [n])[0]["is_loop"]


def flag_loops_all(text, sizes: list[int]) -> Column:
    """CLN03 for several window sizes: array<struct<n, is_loop>>, the text tokenised once."""
    return let(F.regexp_extract_all(F.lower(col(text)), F.lit(_java(TOKEN_RX)), 0), lambda toks: F.array(*[
        F.struct(F.lit(n).alias("n"), _loops(toks, n).alias("is_loop")) for n in sizes]))


def _loops(tokens, n: int) -> Column:
    if n <= 0:
        return F.lit(False)

    def on_tokens(toks):
        def on_tail(tail):
            k = F.size(tail) - 3 * n
            hit = F.exists(F.sequence(F.lit(0), k - 1), lambda i: (
                (F.slice(tail, i + 1, n) == F.slice(tail, i + 1 + n, n))
                & (F.slice(tail, i + 1 + n, n) == F.slice(tail, i + 1 + 2 * n, n))))
            return F.when(F.size(toks) < 4 * n, F.lit(False)).when(k <= 0, F.lit(False)).otherwise(hit)
        return let(F.when(F.size(toks) > 14 * n, F.slice(toks, -14 * n, 14 * n)).otherwise(toks), on_tail)
    return on_tokens(tokens)


def label_outcome(rc, timed_out, loop_abort, oom=None) -> Column:
    """CLN04: outcome with priority OOM > timeout > loop > exit code."""
    rc = col(rc)
    is_oom = rc.isin(OOM_CODES) if oom is None else (col(oom) | rc.isin(OOM_CODES))
    return (F.when(is_oom, "oom").when(col(timed_out), "timeout").when(col(loop_abort), "loop")
             .when(rc != 0, "error").otherwise("success"))


def detokenize(c) -> Column:
    """CLN05: punctuation spacing fixes, in the reference's order."""
    s = col(c)
    for a, b in [(" n't", "n't"), (" )", ")"), ("( ", "("), ('" ', '"'), (' "', '"')]:
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.regexp_replace(s, r" (['.,])", "$1")


def model_family(name) -> Column:
    """PRJ12: family from the file name (first hit wins), lower-cased."""
    n = F.lower(col(name))
    out = None
    for needle, fam in FAMILY_ORDER:
        out = F.when(n.contains(needle), fam) if out is None else out.when(n.contains(needle), fam)
    return out.otherwise("generic")


def quant_tag(name) -> Column:
    """PRJ12: quantisation tag ``Q\\d...`` from the upper-cased name, else 'unknown'."""
    q = F.regexp_extract(F.upper(col(name)), QUANT_RX, 1)
    return F.when(q != "", q).otherwise("unknown")


def family_stop_tokens(family) -> Column:
    """Stop strings of a model family as an array column (literal map lookup)."""
    m = F.create_map(*[x for k, v in FAMILY_STOPS.items()
                       for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return F.coalesce(m[col(family)], F.array(*[F.lit(s) for s in FAMILY_STOPS["generic"]]))


def stop_tokens(name, mode, configured) -> Column:
    """PRJ13: configured stops (by mode always / sabia7 / never) followed by the family's
    stops, duplicates removed keeping first occurrence."""
    md = F.lower(py_strip(col(mode)))
    is_sabia = F.lower(col(name)).contains("sabia")
    base = (F.when(md == "always", col(configured))
             .when(md == "never", F.array().cast("array<string>"))
             .otherwise(F.when(is_sabia, col(configured)).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(base, family_stop_tokens(model_family(name))))
