"""A small labelled table of personal data in sentences, made by rule: what each span is, is known from how it was made."""

from __future__ import annotations

import random

#: Kinds of personal data that the patterns know, in the order of reports, then those that only the model knows.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Rows of the table and the seed of the rule.
ROWS, SEED = 1000, 11

SENTENCES = (
    "Write to {email} for details.", "Contact: {email}, phone {phone}.", "You can reach me under {phone} or at {email}", "E-Mail an {email} oder Telefon {phone}.", "{email} wrote this in may", "mail {email}",
    "Call {phone} before noon.", "Tel. {phone}", "Mon numéro est le {phone}, merci.", "Fax: {phone} (office)", "Llame al {phone} por favor.", "and then {phone} was dialled twice", "Phone {phone}, card {card}",
    "The card {card} was declined.", "paid with {card} on friday", "Karte {card} gesperrt", "Visa {card}, valid thru 09/27", "la tarjeta {card} de ella", "he {card} the other", "of {card} and {ip} to",
    "The host {ip} is down.", "login from {ip} failed", "Server {ip} antwortet nicht", "desde {ip} hasta {ip}", "{email} and {email}", "not {phone} but {phone}", "{card}, {card}", "{ip} {ip}", "ping {ip}:8080", "the {ip} in it", "une adresse {ip}, puis",
    "token = \"{secret}\"", "api_key: {secret}", "password = {secret}", "export SECRET={secret}", "her key is \"{secret}\" they said",
)
CLEAN = (
    "It was on 2024-03-01 at 12:30 that they left.", "am 01.03.2024 um 9.15 Uhr", "See section 4.2.1 and pages 12-15.", "Licensed under CC BY-NC 4.0.", "the GNU General Public License, version 3.", "It costs $1,299.00 or 20% less.",
    "order 48213 was sent in 1998", "follow @handle and @other_one today", "3 + 4 = 7, and x = 12", "room 101, floor 3", "ISBN 978-3-16-148410-0 is a book", "release v2.0.1 of 17 may", "1.234.567,89 euros", "a | b | c | 12 | 7",
    "see https://example.com/a/b?id=3 for it", "#include <stdio.h> // 2 lines", "the of and to in a is that it.", "Der und die in das nicht, von der zu.", "Le la les de un une, et que éê.", "El la de que y ñ, los se ación.", "WORDS IN CAPITALS HERE", "one. Two, three; four: five! six?",
    "(in brackets) and \"in quotes\" or 'so'", "half-way, well-known + more", "1, 2, 3, 10 and 25", "population 8,336,817 in 2020", "score 3:2 (1:1)", "* item one\n* item two\n- item 3", "at the dot of it", "He said: 100 - 200 m", "10/12 of 5.5", "the key of the token is a password", "call the office by phone", "their card and mail",
)
SYLLABLES = ("the", "er", "an", "de", "la", "ou", "ti", "ch", "en", "que", "é", "ung", "re", "ñ")
MARKS = ("###", "%%%", "&&&", "***", "$$$", "!!", "")
NAMES, HOSTS, ENDS = ("jane", "li.wei", "Max_Weber", "ana-maria", "o.neil", "info", "k", "Support", "anne.91", "joão", "inenea"), ("example", "mail7", "uni-bonn", "my.host", "acme", "post"), ("com", "org", "net", "de", "co.uk", "fr")


def value_of(kind: str, rng: random.Random) -> str:
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        name, host, end = rng.choice(NAMES) + rng.choice(("", "", f".{digits(2)}", digits(1))), rng.choice(HOSTS), rng.choice(ENDS)
        return rng.choice((f"{name}@{host}.{end}",) * 3 + (f"{name}@{host}.example.{end}", f"{name} [at] {host} [dot] {end}", f"{name} (at) {host}.{end}", f"{name} @ {host} . {end}", f"{name}[at]{host}[dot]{end}"))
    if kind == "ip":
        parts = [str(rng.randrange(256)) for _ in range(4)]
        return rng.choice((".", ".", ".", "[.]", " . ")).join(parts)
    if kind == "card":
        groups = rng.choice(((16,), (16,), (4, 4, 4, 4), (4, 6, 5), (15,), (19,), (13,)))
        return rng.choice((" ", "-", ".")).join(digits(n) for n in groups)
    if kind == "phone":
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {digits(2)} {digits(7)}", f"0{digits(2)}/{digits(7)}", f"+33 {digits(1)} {' '.join(digits(2) for _ in range(4))}", f"0{digits(1)} {' '.join(digits(2) for _ in range(4))}", f"0{digits(3)} {digits(7)}", f"{a}.{b}.{c}"))
    return rng.choice(("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((32, 40)))), f"sk_live_{''.join(rng.choice('abcdXYZ0189') for _ in range(20))}", "".join(rng.choice("abcdefgHIJ234567") for _ in range(12)) + rng.choice(("", "!"))))


def filler(rng: random.Random) -> str:
    """Some words without any span: prose, one word over and over, words with marks, or a row of a table."""
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4)))
    n, form = rng.randrange(3, 10), rng.randrange(5)
    if form == 0:
        return " ".join([rng.choice((word(), word() + ".", word().capitalize() + ","))] * n)
    if form == 1:
        return " ".join(word() + rng.choice(MARKS) for _ in range(n))
    if form == 2:
        return " | ".join(word() for _ in range(n))
    return " ".join(rng.choice((word(), word(), word(), word() + ",", word() + ".", word().capitalize(), word().upper())) for _ in range(n))


def labelled_rows(rows: int = ROWS, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts, each with (kind, start, end) of its spans in code points. A third of the rows are noisy: marks behind every word, or capitals."""
    rng, out = random.Random(seed), []
    for _ in range(rows):
        text, spans = "", []
        noise = rng.choice(("", "", "", "", "###", "!!", "&&&", " |"))
        capitals = rng.random() < 0.15

        def add(plain: str) -> None:
            nonlocal text
            shown = plain.upper() if capitals and len(plain.upper()) == len(plain) else plain
            text += shown.replace(" ", noise + " ") if noise else shown

        for _ in range(rng.randrange(1, 3)):
            sentence = rng.choice((rng.choice(SENTENCES), rng.choice(SENTENCES), rng.choice(CLEAN), filler(rng), filler(rng)))
            while "{" in sentence:
                before, _, rest = sentence.partition("{")
                kind, _, sentence = rest.partition("}")
                add(before)
                value = value_of(kind, rng)
                value = value.upper() if capitals and kind != "card" and len(value.upper()) == len(value) else value
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            add(sentence + rng.choice((" ", "\n", noise + " ")))
        out.append((text, spans))
    return out
