"""Command line: build an index, ask it, chat with it."""

from __future__ import annotations

import argparse
import os

from corpusflow.config import CHAT, ONE_SHOT, ChunkOptions, ParseOptions
from corpusflow.encoders import RemoteEncoder
from corpusflow.engine import Engine
from corpusflow.session import local_session

HELP = "help, quit, clear, history, verbose, export PATH, stats, sessions, new; anything else is a question"


def _chat(engine: Engine, session: str, verbose: bool, timeout: int) -> None:
    config = CHAT.replace(timeout=timeout)
    while True:
        try:
            line = input("> ").strip()
        except EOFError:
            return
        word, _, rest = line.partition(" ")
        if line in ("quit", "exit"):
            return
        if line == "help":
            print(HELP)
        elif line == "clear":
            engine.sessions.clear(session)
        elif line == "history":
            engine.sessions.history(session, 10).show(truncate=150)
        elif line == "verbose":
            verbose = not verbose
        elif word == "export" and rest:
            engine.sessions.export(session, rest)
        elif line == "stats":
            engine.sessions.stats(session).show()
        elif line == "sessions":
            engine.sessions.list().show(truncate=False)
        elif line == "new":
            session = engine.sessions.new()
        elif line:
            if verbose:
                for name, df in engine.explain_retrieval(line, config).items():
                    print(name)
                    df.orderBy("rank").show(5)
            answer = engine.ask(line, session, config)
            print(answer.text, answer.sources, sep="\n\n")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="corpusflow")
    commands = parser.add_subparsers(dest="command", required=True)
    defaults = ChunkOptions()
    wanted = {
        "build": {"--data": {"required": True}, "--target-tokens": {"default": defaults.target_tokens, "type": int}, "--overlap": {"default": defaults.overlap, "type": float}, "--skip": {"nargs": "*", "default": [], "choices": ["parse", "chunk", "embed"]}, "--force": {"action": "store_true"},
                  "--no-pdf-tables-as-csv": {"action": "store_true"}},
        "query": {"question": {}, "--topk": {"default": ONE_SHOT.final_k, "type": int}},
        "chat": {"--session": {}, "--new-session": {"action": "store_true"}, "--verbose": {"action": "store_true"}},
        "doctor": {},
    }
    for command, options in wanted.items():
        sub = commands.add_parser(command)
        if command in ("query", "chat"):
            options["--timeout"] = {"default": ONE_SHOT.timeout, "type": int}
        if command in ("build", "query", "chat"):
            options |= {"--encoder": {"default": "hashing", "choices": ["hashing", "remote"]}, "--encoder-model": {"default": ""}, "--encoder-url": {"default": os.environ.get("EMBEDDING_URL", "")}}
        for name, settings in {**options, "--index": {"default": "artifacts"}}.items():
            sub.add_argument(name, **settings)
    a = parser.parse_args(arguments)
    options = ChunkOptions(a.target_tokens, a.overlap) if a.command == "build" else None
    encoder = RemoteEncoder(a.encoder_url, a.encoder_model) if getattr(a, "encoder", "") == "remote" else None
    engine = Engine(local_session(), a.index, encoder, chunk_options=options, parse_options=ParseOptions(pdf_tables_as_csv=not getattr(a, "no_pdf_tables_as_csv", False)))
    if a.command == "build":
        print(engine.build(a.data, tuple(a.skip), a.force))
    elif a.command == "query":
        answer = engine.answer(a.question, ONE_SHOT.replace(final_k=a.topk, timeout=a.timeout))
        print(answer.text, answer.sources, sep="\n\n")
    elif a.command == "chat":
        session = a.session or (None if a.new_session else engine.sessions.resume()) or engine.sessions.new()
        _chat(engine, session, a.verbose, a.timeout)
    else:
        print(engine.doctor())


if __name__ == "__main__":
    main()
