"""Command line: python -m lorekeep <command> --help"""

from __future__ import annotations

import argparse
import os

from lorekeep import get_session
from lorekeep.plans import imports
from lorekeep.plans.service import ChatService, TutorService
from lorekeep.sources import files
from lorekeep.sources.collections import Collections, drop_staged
from lorekeep.sources.pages import MuPdfPages
from lorekeep.sources.persona_store import PersonaStore
from lorekeep.sources.providers import HashEmbedder, HttpChatModel, HttpEmbedder
from lorekeep.sources.session_store import SessionStore


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lorekeep")
    top.add_argument("--root", default="lorekeep-data", help="folder of collections, personas and sessions")
    top.add_argument("--api", help="base URL of the model service; without it a hashing embedder is used")
    top.add_argument("--api-key", default="")
    top.add_argument("--chat-model", default="")
    top.add_argument("--embed-model", default="")
    commands = top.add_subparsers(dest="command", required=True)

    clean = commands.add_parser("clean", help="filter and deduplicate chat files")
    clean.add_argument("--folder", default="csv")
    clean.add_argument("--out", default="csv_clean")
    clean.add_argument("--pattern", default="*.csv")
    clean.add_argument("--inplace", action="store_true")

    chat = commands.add_parser("import-chat", help="import chat files into the collection of a persona")
    chat.add_argument("--persona", required=True, help="id of a persona, or the name of a new one")
    chat.add_argument("--system-prompt", default="用自然、口语化的中文，以第一人称回答。")
    chat.add_argument("--base", default=".", help="folder that holds csv_clean or csv")
    chat.add_argument("--pattern", default=os.environ.get("CSV_FILE_PATTERN", "*.csv"))
    chat.add_argument("--full", action="store_true", help="replace the collection instead of adding to it")
    chat.add_argument("--embed-tasks", type=int, default=None)

    books = commands.add_parser("import-books", help="import PDF books into a collection")
    books.add_argument("--folder", default="textbook")
    books.add_argument("--collection", default="textbook_embeddings")
    books.add_argument("--chunk-size", type=int, default=1000)
    books.add_argument("--overlap", type=int, default=200)
    books.add_argument("--full", action="store_true")
    books.add_argument("--embed-tasks", type=int, default=None)

    ask = commands.add_parser("ask", help="ask a persona, or the tutor")
    ask.add_argument("message")
    ask.add_argument("--persona")
    ask.add_argument("--session", default="default")
    ask.add_argument("--tutor", action="store_true")

    commands.add_parser("collections", help="names and sizes of the collections")
    commands.add_parser("personas", help="the persona catalogue")
    return top


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = get_session("lorekeep")
    store = Collections(spark, f"{args.root}/collections")
    people = PersonaStore(spark, f"{args.root}/personas")
    sessions = SessionStore(spark, f"{args.root}/sessions")
    embedder = HttpEmbedder(f"{args.api}/v1/embeddings", args.api_key, args.embed_model) if args.api else HashEmbedder()

    if args.command == "clean":
        counts = imports.clean_chat_folder(spark, args.folder, args.out, args.pattern, args.inplace)
        counts.orderBy("source").show(truncate=False)
        imports.chatrows.cleaning_totals(counts).show()
    elif args.command == "import-chat":
        persona = people.get(args.persona) or people.create(args.persona, args.system_prompt)
        folder = files.chat_folder(spark, args.base)
        print(
            imports.import_chat(
                spark, store, persona.collection, folder, embedder, args.pattern, not args.full, people, persona.id, args.embed_tasks
            )
        )
    elif args.command == "import-books":
        print(
            imports.import_books(
                spark, store, args.collection, args.folder, MuPdfPages(), embedder, not args.full,
                embed_tasks=args.embed_tasks, size=args.chunk_size, overlap=args.overlap,
            )
        )
    elif args.command == "ask":
        if not args.api:
            raise SystemExit("ask needs --api")
        model = HttpChatModel(f"{args.api}/v1/chat/completions", args.api_key, args.chat_model)
        if args.tutor:
            print(TutorService(spark, store, sessions, embedder, model).chat(args.message, args.session))
        else:
            print(ChatService(spark, store, people, sessions, embedder, model).chat(args.message, args.session, args.persona))
    elif args.command == "collections":
        store.sizes().orderBy("name").show(truncate=False)
    else:
        people.list().show(truncate=False)
    drop_staged(spark)


if __name__ == "__main__":
    main()
