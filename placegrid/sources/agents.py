"""Vision-language models as plug-ins: chats over images, retries, generated images, and what is kept of them.

A chat model is a function from a list of messages ({role, content}) to a reply; an image model returns (images, text).
They are loaded once a Python worker, through ``worker``. A conversation is folded in one task, as its state demands;
conversations spread over all tasks. A failed call after its retries gives an error in its row and spoils no other.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Chat = Callable[[list[dict]], str]
Draw = Callable[[list[dict]], tuple[list[bytes | None], str]]
_workers: dict[str, object] = {}


def worker[T](name: str, load: Callable[[], T]) -> T:
    """What ``load`` makes, made once in a Python worker and kept under ``name`` (which should tell models apart)."""
    if name not in _workers:
        _workers[name] = load()
    return _workers[name]


def backoff(attempt: int, jitter: float) -> float:
    """Seconds to wait after a failed attempt (from 0); jitter lies in 0 .. 1."""
    return 0.5 * 2**attempt + 0.25 * jitter


def retried[T](call: Callable[[], T], tries: int = 3, wait: Callable[[float], None] = time.sleep) -> T:
    for attempt in range(tries):
        try:
            return call()
        except Exception:
            if attempt == tries - 1:
                raise
            wait(backoff(attempt, random.random()))
    raise ValueError("tries must be positive")


def user(prompt: str, images: list[str]) -> dict:
    """A user message: images first, then the prompt."""
    return {"role": "user", "content": [*({"type": "image_url", "image_url": {"url": u}} for u in images), {"type": "text", "text": prompt}]}


def replies(history: list[dict], prompts: list[str], images: list[str], chat: Chat) -> list[str]:
    """The replies to prompts asked one after another: each prompt is taken out of the history again, its reply stays."""
    out = []
    for prompt in prompts:
        out.append(chat([*history, user(prompt, images)]))
        history.append({"role": "assistant", "content": out[-1]})
    return out


class Conversation:
    """A history that begins with its system prompt."""

    def __init__(self, system: str | None = None) -> None:
        self.set_system(system)

    def set_system(self, system: str | None) -> None:
        """A new system prompt; the history starts afresh."""
        self.system = system
        self.clear()

    def clear(self) -> None:
        self.history = [{"role": "system", "content": self.system}] if self.system else []

    def say(self, prompt: str, images: list[str], chat: Chat) -> str:
        """Prompt and reply both stay in the history."""
        message = user(prompt, images)
        reply = chat([*self.history, message])
        self.history += [message, {"role": "assistant", "content": reply}]
        return reply


def chatted(turns: DataFrame, name: str, load: Callable[[], Chat], system: str | None = None, keep_prompts: bool = False, tries: int = 1) -> DataFrame:
    """conversation, turn, reply, error for rows (conversation, turn, prompt): each conversation's prompts in order of turn.

    ``keep_prompts``: prompts stay in the history. After an error a conversation goes on without that turn.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        chat, talk, out = worker(name, load), Conversation(system), []
        for r in rows.sort_values("turn").itertuples(index=False):
            try:
                call = (lambda: talk.say(r.prompt, [], chat)) if keep_prompts else (lambda: replies(talk.history, [r.prompt], [], chat)[0])  # noqa: B023
                out.append((r.conversation, r.turn, retried(call, tries), None))
            except Exception as e:  # noqa: BLE001  user code: recorded, never fatal
                out.append((r.conversation, r.turn, None, repr(e)))
        return pd.DataFrame(out, columns=["conversation", "turn", "reply", "error"])

    rows = turns.select("conversation", "turn", "prompt")
    kinds = dict(rows.dtypes)
    return rows.groupBy("conversation").applyInPandas(run, f"conversation {kinds['conversation']}, turn {kinds['turn']}, reply string, error string")


def analysed(images: DataFrame, name: str, load: Callable[[], Chat], prompts: list[str], tries: int = 3) -> DataFrame:
    """item, response, error for rows (item, url): all prompts in turn about one image; the last reply counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = worker(name, load)
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                try:
                    out.append((r.item, retried(lambda: replies([], prompts, [r.url], chat)[-1], tries), None))  # noqa: B023
                except Exception as e:  # noqa: BLE001
                    out.append((r.item, None, repr(e)))
            yield pd.DataFrame(out, columns=["item", "response", "error"])

    return images.select("item", "url").mapInPandas(run, "item string, response string, error string")


def reranked(tasks: DataFrame, name: str, load: Callable[[], Chat], prompt: str, tries: int = 3) -> DataFrame:
    """item, response, error for rows (item, candidates): one question over the query and its candidates in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = worker(name, load)
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                try:
                    out.append((r.item, retried(lambda: chat([user(prompt, [r.item, *r.candidates])]), tries), None))  # noqa: B023
                except Exception as e:  # noqa: BLE001
                    out.append((r.item, None, repr(e)))
            yield pd.DataFrame(out, columns=["item", "response", "error"])

    return tasks.select("item", "candidates").mapInPandas(run, "item string, response string, error string")


def generated(images: DataFrame, name: str, load: Callable[[], Draw], prompts: list[str], tries: int = 3) -> DataFrame:
    """item, index, image, text, error: the first prompt's images and those of the further prompts, numbered together.

    A null image keeps its number; an item without images, or whose call failed, has one row without index and image.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw = worker(name, load)
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                try:
                    got = [retried(lambda: draw([user(p, [r.url])]), tries) for p in prompts]  # noqa: B023
                except Exception as e:  # noqa: BLE001
                    out.append((r.item, None, None, None, repr(e)))
                    continue
                made, text = [i for images, _ in got for i in images], "\n".join(t for _, t in got if t)
                out += [(r.item, n, i, text, None) for n, i in enumerate(made)] or [(r.item, None, None, text, None)]
            yield pd.DataFrame(out, columns=["item", "index", "image", "text", "error"]).astype({"index": "Int32"})

    return images.select("item", "url").mapInPandas(run, "item string, index int, image binary, text string, error string")


def image_name(prefix: Column, index: Column, image: Column) -> Column:
    """<prefix>_<index>.jpg, NULL for a null image."""
    return F.when(image.isNotNull(), F.concat(prefix, F.lit("_"), index.cast("string"), F.lit(".jpg")))


def history_json(turns: DataFrame) -> DataFrame:
    """conversation, json: histories from rows (conversation, turn, role, content) as they are saved."""
    rows = turns.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("t"))
    return rows.select("conversation", F.to_json(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("json"))


def loaded_history(saved: DataFrame) -> DataFrame:
    """conversation, turn (from 0), role, content of saved histories."""
    rows = saved.select("conversation", F.posexplode(F.from_json("json", "array<struct<role:string,content:string>>")).alias("turn", "m"))
    return rows.select("conversation", "turn", "m.role", "m.content")


def stub_chat() -> Chat:
    """A deterministic stand-in: how many messages it was shown, and the length of the last text."""
    return lambda messages: f"{len(messages)}:{len(messages[-1]['content'][-1]['text'])}"


def stub_draw(images: int = 2) -> Callable[[], Draw]:
    return lambda: lambda messages: ([json.dumps(messages[-1]["content"][-1]["text"]).encode() if i else None for i in range(images)], f"{images} images")
