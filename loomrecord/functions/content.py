"""What a text holds: JSON, Markdown or plain text, and the language of code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomrecord.functions import jsonvalue as J
from loomrecord.functions.embedded import embedded_json

# Terminal escapes, and the number that tools put before a line.
ESCAPES = "(?:\u001b\\][^\u0007]*(?:\u0007|\u001b\\\\)|\u001b\\[[0-?]*[ -/]*[@-~])"
NUMBERED = r"(?dm)^[^\S\n]*\d+:[^\S\n]?"
# Signals of code by language, in the order in which languages are tried; two signals decide.
SIGNALS = {
    "rust": [r"\b(?:use|pub|crate|mod|impl|struct|enum|trait)\s+[A-Za-z_]", r"\bfn\s+[A-Za-z_][\w]*\s*\(", r"\blet\s+(?:mut\s+)?[A-Za-z_][\w]*\s*=", r"\b(?:match|async|await)\b", r"::[A-Za-z_][\w]*"],
    "shell": [r"(?m)^\s*#!.*\b(?:sh|bash|zsh|fish|pwsh|powershell)\b", r"\b(?:if|then|fi|for|foreach|do|done|case|esac)\b", r"(?:^|\s)(?:Get-[A-Za-z]+|Set-[A-Za-z]+|Write-[A-Za-z]+|npm|pnpm|cargo|git)\b",
              r"\$env:[A-Za-z_]|\bexport\s+[A-Za-z_][\w]*=", r"\[\s+-[a-zA-Z]+\s+[^\]]+\]"],
    "python": [r"(?m)^\s*def\s+[A-Za-z_][\w]*\s*\(", r"(?m)^\s*(?:from\s+\S+\s+)?import\s+\S+", r"\b(?:elif|lambda|None|True|False)\b"],
    "javascript": [r"\b(?:const|let|var|function|import|export)\s+[A-Za-z_$]", r"\b(?:await|async)\b|=>", r"\b(?:console|process|require)\.[A-Za-z_]"],
}
# Markdown: headings, fences, lists and quotes, rules, tables, and marks inside a line. `\h`-like
# classes stay within a line; groups that may repeat often are possessive, which Java loops over.
MARKS = [
    r"(?dm)^[^\S\n]*#{1,6}[^\S\n]+\S", r"(?dm)^[^\S\n]*(?:`{3,}|~{3,})[^\S\n]*[A-Za-z0-9_+#.-]*[^\S\n]*$", r"(?dm)^[^\S\n]*(?:[-*+][^\S\n]+\S|\d+[.)][^\S\n]+\S|>)",
    r"(?dm)^[^\S\n]*(?:(?:\*[^\S\n]*+){3,}+|(?:-[^\S\n]*+){3,}+|(?:_[^\S\n]*+){3,}+)$",
    r"(?dm)^[^\n|]*\|[^\n]*\n[^\S\n]*\|?[^\S\n]*:?-{3,}+:?[^\S\n]*(?:\|[^\S\n]*+:?-{3,}+:?[^\S\n]*+)++\|?[^\S\n]*$", r"\*\*[^*\n]+\*\*|`[^`\n]+`|\[[^\]\n]+\]\([^)\n]+\)",
]
#: A word's edge among ASCII characters only.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _trim(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s++", ""), r"(?<!\s)\s++\z", "")


def _strict(text: str) -> str:
    """SQL text of the parsed value of a whole strict document, NULL for anything else."""
    return J.bind_sql(f"try_parse_json('[' || {text} || ',0]')", "w", "if(try_variant_get(w, '$[1]', 'bigint') = 0 AND try_variant_get(w, '$[2]', 'variant') IS NULL, try_variant_get(w, '$[0]', 'variant'), null)")


def _is_container(v: str) -> str:
    return f"coalesce(schema_of_variant({v}) rlike '^(OBJECT|ARRAY)', false)"


def whole_json(text: Column) -> Column:
    """Whether a text is a JSON object or array, or a JSON string that holds nothing else."""
    inner = J.bind_sql("trim(BOTH ' \t\n\r' FROM try_variant_get(p, '$', 'string'))", "n", f"if(n rlike '^[{{\\\\[]', {_is_container(_strict('n'))}, false)")
    return J.let_sql(text, J.bind_sql(_strict("t"), "p", f"coalesce(if(schema_of_variant(p) = 'STRING', {inner}, {_is_container('p')}), false)"), "t")


def decoded_text(text: Column) -> Column:
    """One layer of escaping taken off texts that show it: a JSON string, or written-out line ends. Others stay."""
    trimmed = _trim(text)
    quoted = J.let_sql(F.when(trimmed.startswith('"') & trimmed.endswith('"'), trimmed), J.bind_sql(_strict("t"), "p", "if(schema_of_variant(p) = 'STRING', try_variant_get(p, '$', 'string'), null)"), "t")
    bracketed = trimmed.rlike(r"(?s)^(?:\{.*\}|\[.*\])$")
    kept = F.when(bracketed, J.let_sql(F.when(bracketed, trimmed), _is_container(_strict("t")), "t")).otherwise(False)
    lines = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\r\\n|\\n", "\n"), r"\\r", "\r"), r'\\"', '"')
    return F.when(kept, text).when(quoted.isNotNull(), quoted).when(text.rlike(r"\\(?:r\\n|n|r)"), lines).otherwise(text)


def has_markdown(text: Column) -> Column:
    """Whether any line or mark of a text is Markdown."""
    return reduce(Column.__or__, [text.rlike(p) for p in MARKS])


def _lines_numbered(text: Column) -> Column:
    """Whether half of the lines with text, and at least two, begin with a number and a colon."""
    lines = F.regexp_count(text, F.lit(r"(?dm)^.*\S"))
    numbered = F.regexp_count(text, F.lit(NUMBERED))
    return (numbered >= 2) & (numbered * 2 >= lines)


def content_class(text: Column) -> Column:
    """json, markdown or text; NULL for NULL. Whole texts are judged, however long.

    Prose with a JSON object or array in it is json, unless it shows Markdown. Terminal
    escapes and line numbers do not hide Markdown.
    """
    shown = decoded_text(text)
    plain = F.regexp_replace(shown, ESCAPES, "")
    marked = has_markdown(plain) | _lines_numbered(plain) & has_markdown(F.regexp_replace(plain, NUMBERED, ""))
    whole = whole_json(_trim(shown))
    # Only texts that the answer may depend on are sent to Python.
    held = F.size(embedded_json(F.when(~marked & ~whole & shown.rlike(r"[{\[]"), shown), most=1)) > 0
    return F.when(text.isNull(), None).when(whole, "json").when(marked, "markdown").when(held, "json").otherwise("text")


def code_language(text: Column, hint: Column | None = None) -> Column:
    """The hint if there is one, else the first language with two signals in the text, else NULL."""
    plain = F.regexp_replace(F.regexp_replace(text, ESCAPES, ""), NUMBERED, "")
    guess = F.lit(None).cast("string")
    for name, patterns in reversed(SIGNALS.items()):
        seen = reduce(Column.__add__, [plain.rlike(p.replace(r"\b", _EDGE)).cast("int") for p in patterns])
        guess = F.when(seen >= 2, name).otherwise(guess)
    given = F.nullif(F.lower(F.trim(hint)), F.lit("")) if hint is not None else F.lit(None).cast("string")
    return F.coalesce(given, guess)
