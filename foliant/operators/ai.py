"""Model calls over documents: prompts, calls with retries, and replies as columns.

Prompts, requests and replies are native expressions. A call goes through a service (``answered``) or a function that the
caller gives, (system, prompt) -> reply (``replied``), in Arrow batches; a row whose call fails has an error instead of a reply.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NetworkError
from ..functions.classify import model_tags
from ..functions.text import strip

# What makes an error worth another try, and what rules it out.
NOT_RETRIABLE = ("401", "403", "400", "404", "invalid api key", "authentication", "unauthorized", "forbidden")
RETRIABLE = ("rate limit", "429", "500", "502", "503", "504", "timeout", "connection", "network")
# Models that see images, and what names of a local server's begin with.
VISION_MODELS = (
    "claude-3-opus-20240229", "claude-3-sonnet-20240229", "claude-3-haiku-20240307", "claude-3-5-sonnet-20240620", "claude-3-5-sonnet-20241022", "gpt-4o", "gpt-4o-mini", "gpt-4-vision-preview", "gpt-4-turbo", "gpt-4-turbo-2024-04-09",
    "llava", "llava:latest", "bakllava", "bakllava:latest", "llava-phi3", "llava-phi3:latest", "llava:13b", "llava:34b",
)
LOCAL_VISION = ("llava", "bakllava")
# Addresses of the services.
ENDPOINTS = {
    "anthropic": "https://api.anthropic.com/v1/messages", "openai": "https://api.openai.com/v1/chat/completions", "openrouter": "https://openrouter.ai/api/v1/chat/completions", "ollama": "http://localhost:11434/v1/chat/completions",
    "lmstudio": "http://localhost:1234/v1/chat/completions", "cloudflare": "https://api.cloudflare.com/client/v4/accounts/{account}/ai/run/{model}",
}
STYLES = {"concise": "Summarise the text in a few sentences.", "detailed": "Summarise the text in detail, section by section.", "bullet": "Summarise the text as bullet points."}
QUALITY_SCORES = ("overall", "readability", "structure", "completeness", "coherence")
LEVELS = {"high": 0.9, "medium": 0.6, "low": 0.3}


@dataclass(frozen=True)
class Policy:
    max_retries: int = 3
    retry_delay: float = 1.0
    sleep: Callable[[float], None] = time.sleep


def retriable(error: Exception) -> bool:
    """By what the error says, if that is anything; network errors are."""
    said = str(error).lower()
    if any(x in said for x in NOT_RETRIABLE):
        return False
    return isinstance(error, (NetworkError, ConnectionError, TimeoutError)) or any(x in said for x in RETRIABLE)


def retriable_message(message: str | Column) -> Column:
    """``retriable`` for the messages of logged errors."""
    said = F.lower(F.col(message) if isinstance(message, str) else message)
    holds = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda x: F.contains(said, x))
    return ~holds(NOT_RETRIABLE) & holds(RETRIABLE)


def with_retries(call: Callable[[str, str], str], policy: Policy = Policy()) -> Callable[[str, str], str]:
    """``call``, tried again after a delay that doubles."""

    def run(system: str, prompt: str) -> str:
        for attempt in range(policy.max_retries + 1):
            try:
                return call(system, prompt)
            except Exception as e:
                if attempt == policy.max_retries or not retriable(e):
                    raise
                policy.sleep(policy.retry_delay * 2**attempt)
        raise AssertionError("unreachable")

    return run


def sees_images(provider: str, model: str) -> bool:
    """By the model's whole name; of one local server by its beginning, and the other is taken at its word."""
    return model in VISION_MODELS or provider == "lmstudio" or provider == "ollama" and model.startswith(LOCAL_VISION)


def with_vision(rows: DataFrame, provider_col: str = "provider", model_col: str = "model") -> DataFrame:
    """``rows`` with ``vision``: ``sees_images`` of their provider and model."""
    p, m = F.col(provider_col), F.col(model_col)
    local = F.exists(F.array(*map(F.lit, LOCAL_VISION)), lambda x: m.startswith(x))
    return rows.withColumn("vision", m.isin(*VISION_MODELS) | (p == "lmstudio") | ((p == "ollama") & local))


# --- services --------------------------------------------------------------------------------------------------------


def request(provider: str, prompt: str | Column, model: str, system: str | None = None, max_tokens: int = 1024, temperature: float = 0.3, image: Column | None = None, media_type: str | Column = "image/png") -> Column:
    """The body of a call as JSON. ``image`` (binary) goes before the prompt."""
    if provider not in ENDPOINTS:
        raise ValueError(f"unknown provider: {provider}")
    said = F.col(prompt) if isinstance(prompt, str) else prompt
    kind = F.lit(media_type) if isinstance(media_type, str) else media_type
    lit = lambda v, name: F.lit(v).alias(name)
    head = [lit(model, "model"), lit(max_tokens, "max_tokens"), lit(temperature, "temperature")]
    if image is None:
        content = said
    elif provider == "anthropic":
        source = F.struct(lit("base64", "type"), kind.alias("media_type"), F.base64(image).alias("data"))
        content = F.concat(F.lit("["), F.to_json(F.struct(lit("image", "type"), source.alias("source"))), F.lit(","), F.to_json(F.struct(lit("text", "type"), said.alias("text"))), F.lit("]"))
    else:
        url = F.struct(F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(image)).alias("url"))
        content = F.concat(F.lit("["), F.to_json(F.struct(lit("image_url", "type"), url.alias("image_url"))), F.lit(","), F.to_json(F.struct(lit("text", "type"), said.alias("text"))), F.lit("]"))
    # content is a string, or a list that is JSON already
    user = F.to_json(F.struct(lit("user", "role"), content.alias("content"))) if image is None else F.concat(F.lit('{"role":"user","content":'), content, F.lit("}"))
    messages = [user]
    if provider == "anthropic":
        head.append(lit(system or "", "system"))
    elif system:
        messages.insert(0, F.to_json(F.struct(lit("system", "role"), lit(system, "content"))))
    if provider == "cloudflare":
        head = [lit(max_tokens, "max_tokens")]
    top = F.to_json(F.struct(*head))
    return F.concat(F.substring(top, F.lit(1), F.length(top) - 1), F.lit(',"messages":['), F.concat_ws(",", *messages), F.lit("]}"))


def response_text(provider: str, body: str | Column) -> Column:
    """The text of a service's answer; null if it has none of the form."""
    if provider == "anthropic":
        return F.get_json_object(body, "$.content[0].text")
    if provider == "cloudflare":
        ok = F.get_json_object(body, "$.success") == "true"
        return F.when(ok, F.coalesce(F.get_json_object(body, "$.result.response"), F.get_json_object(body, "$.result")))
    return F.when(F.get_json_object(body, "$.choices[0].message").isNotNull(), F.coalesce(F.get_json_object(body, "$.choices[0].message.content"), F.lit("")))


def headers(provider: str, key: str | None) -> dict[str, str]:
    out = {"Content-Type": "application/json"}
    if provider == "anthropic":
        return out | {"x-api-key": key or "", "anthropic-version": "2023-06-01"}
    return out | ({"Authorization": f"Bearer {key}"} if key else {})


def post(url: str, head: dict[str, str], body: str, timeout: float = 60) -> str:
    """One call over the network; a status of 400 or more is an error that names it."""
    call = urllib.request.Request(url, body.encode(), head)
    try:
        with urllib.request.urlopen(call, timeout=timeout) as answer:
            return answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        raise NetworkError(f"{e.code} {e.reason}") from e


def answered(rows: DataFrame, provider: str, model: str, key: str | None = None, account: str = "", prompt_col: str = "prompt", system: str | None = None, policy: Policy = Policy(), send: Callable[[str, dict, str], str] = post, **options) -> DataFrame:
    """``rows`` with ``reply`` and ``error`` from a service. Null prompts are not sent; an answer without text is an error."""
    url, head = ENDPOINTS[provider].format(account=account, model=model), headers(provider, key)
    asked = rows.withColumn("request", F.when(F.col(prompt_col).isNotNull(), request(provider, prompt_col, model, system, **options)))
    out = replied(asked, lambda _, body: send(url, head, body), "", "request", policy)
    said = response_text(provider, "reply")
    error = F.coalesce("error", F.when(F.col("reply").isNotNull() & said.isNull(), F.concat(F.lit("no text in the answer: "), F.substring("reply", 1, 200))))
    return out.withColumn("error", error).withColumn("reply", said).drop("request")


def replied(rows: DataFrame, call: Callable[[str, str], str], system: str, prompt_col: str = "prompt", policy: Policy = Policy()) -> DataFrame:
    """``rows`` with ``reply`` and ``error``. Null prompts are not sent."""
    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])
    at = rows.columns.index(prompt_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = with_retries(call, policy)
        for batch in batches:
            replies, errors = [], []
            for prompt in batch.column(at).to_pylist():
                try:
                    replies.append(ask(system, prompt) if prompt is not None else None)
                    errors.append(None)
                except Exception as e:  # a failed call is a row with an error
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


# --- prompts ---------------------------------------------------------------------------------------------------------


def tag_prompt(content: str | Column, most: int = 10) -> Column:
    if not 1 <= most <= 100:
        raise ValueError("the number of tags must be from 1 to 100")
    return F.concat(F.lit(f"Give up to {most} tags for this text, with commas between:\n\n"), F.substring(content, 1, 2000))


def summary_prompt(content: str | Column, style: str = "concise", most: int = 500) -> Column:
    if style not in STYLES:
        raise ValueError(f"style must be one of {sorted(STYLES)}")
    if not 1 <= most <= 10_000:
        raise ValueError("the length must be from 1 to 10000")
    return F.concat(F.lit(f"{STYLES[style]} Use at most {most} words.\n\n"), F.substring(content, 1, 5000))


def quality_prompt(content: str | Column) -> Column:
    asked = "\n".join(f"{s.capitalize()}: <0 to 100>" for s in QUALITY_SCORES)
    return F.concat(F.lit(f"Rate this text:\n{asked}\nStrengths:\n- ...\nSuggestions:\n- ...\n\n"), F.substring(content, 1, 3000))


def image_prompt(content: Column, position: Column, alt: Column) -> Column:
    """Asks for a description, with the text within 200 characters of the image and what alternative text there is."""
    a = F.greatest(position - 200, F.lit(0))
    around = F.substring(content, (a + 1).cast("int"), (position + 200 - a).cast("int"))
    return F.concat(F.lit("Describe the image.\nContext: "), F.coalesce(around, F.lit("")), F.lit("\nExisting text: "), F.coalesce(alt, F.lit("")))


# --- replies ---------------------------------------------------------------------------------------------------------


def tags(reply: str | Column = "reply", most: int = 10) -> Column:
    return F.coalesce(model_tags(reply, most), F.array().cast("array<string>"))


def labelled_number(reply: str | Column, label: str) -> Column:
    """The whole number after ``label:``, held to 0..100; 0 without one."""
    n = F.regexp_extract(reply, rf"(?im)^[\s*#-]*{label}[^:\n]*:\s*\**\s*(-?\d{{1,6}})", 1)
    return F.least(F.greatest(F.coalesce(F.nullif(n, F.lit("")).try_cast("int"), F.lit(0)), F.lit(0)), F.lit(100))


def section_items(reply: str | Column, label: str) -> Column:
    """Bullets below ``label:`` up to the next label."""
    body = F.regexp_extract(reply, rf"(?is)(?:\A|\n)[*#\s]*{label}[*\s]*:[*]*(.*?)(?=\n[*#]*[A-Za-z ]+[*]*:|\z)", 1)
    items = F.transform(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"\A\s*(?:[-*•]|\d+[.)])\s+")), lambda x: strip(F.regexp_replace(x, r"\A\s*(?:[-*•]|\d+[.)])\s+", "")))
    return F.filter(items, lambda x: x != "")


def quality(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Scores and lists of a quality reply."""
    scores = {f"{s}_score": labelled_number(reply, s) for s in QUALITY_SCORES}
    return rows.withColumns({**scores, "strengths": section_items(reply, "strengths"), "suggestions": section_items(reply, "suggestions")})


def compared(scored: DataFrame, pairs: DataFrame, id_col: str = "document_id") -> DataFrame:
    """For pairs (first, second) of documents: both scores, the better (a tie goes to the first) and the difference."""
    side = lambda c: scored.select(F.col(id_col).alias(c), F.col("overall_score").alias(f"{c}_score"))
    both = pairs.join(side("first"), "first").join(side("second"), "second")
    return both.select("first", "second", "first_score", "second_score", F.when(F.col("second_score") > F.col("first_score"), F.col("second")).otherwise(F.col("first")).alias("better"), F.abs(F.col("first_score") - F.col("second_score")).alias("difference"))


def image_analysis(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Description, text, type, objects, alternative text and confidence of an image reply with labelled sections."""
    part = lambda label: F.nullif(strip(F.regexp_extract(reply, rf"(?is)(?:\A|\n)\s*{label}\s*:(.*?)(?=\n\s*[A-Z][A-Z_ ]+:|\z)", 1)), F.lit(""))
    said = F.lower(part("CONFIDENCE"))
    confidence = F.when(said.isNull(), 0.5)
    for word, value in LEVELS.items():
        confidence = confidence.when(F.contains(said, F.lit(word)), value)
    objects = F.filter(F.transform(F.split(part("OBJECTS"), "[,\n]"), lambda x: strip(F.regexp_replace(x, r"\A\s*[-*•]\s*", ""))), lambda x: x != "")
    return rows.withColumns({"description": part("DESCRIPTION"), "text_content": part("TEXT"), "image_type": part("TYPE"), "objects": F.coalesce(objects, F.array().cast("array<string>")), "alt_text": part("ALT_TEXT"), "confidence": confidence.otherwise(0.5)})


def photo_analysis(rows: DataFrame, reply: str = "reply") -> DataFrame:
    """Known keys of the first {...} of a photo reply; where it isn't JSON, caption, scene and sentiment by their labels."""
    keys = "caption string, description string, scene string, sentiment string, mood string, subjects array<string>, tags array<string>"
    found = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), keys)
    by_label = lambda k: F.nullif(F.regexp_extract(reply, rf'(?i)"?{k}"?\s*[:=]\s*"?([^"\n,}}]+)', 1), F.lit(""))
    names = [x.split()[0] for x in keys.split(", ")]
    return rows.withColumns({n: F.coalesce(found[n], strip(by_label(n))) if n in ("caption", "scene", "sentiment") else found[n] for n in names})


def described_images(documents: DataFrame, call: Callable[[str, str], str], policy: Policy = Policy()) -> DataFrame:
    """(document_id, image_id, alt_text, error): a description of every image by the text around it; a failed call is a row with an error."""
    rows = documents.select("document_id", "content", F.inline("images"))
    asked = rows.select("document_id", "image_id", image_prompt(F.col("content"), F.col("position"), F.col("alt_text")).alias("prompt"))
    return replied(asked, call, "You describe images.", policy=policy).select("document_id", "image_id", strip("reply").alias("alt_text"), "error")


def with_descriptions(documents: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Documents whose images take their new alternative texts; images without one keep theirs."""
    pairs = descriptions.where("alt_text is not null").groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("image_id", "alt_text"))).alias("__alts"))
    new = F.transform("images", lambda i: i.withField("alt_text", F.coalesce(F.try_element_at("__alts", i["image_id"]), i["alt_text"])))
    return documents.join(pairs, "document_id", "left").withColumn("images", F.when(F.col("__alts").isNotNull(), new).otherwise(F.col("images"))).drop("__alts")
