"""Labelled findings that share no word list, name or template with the scanner's own training sample: names and words come from Python's library and from the documents of the tests."""

import ast
import base64
import inspect
import random
import re
import string
import textwrap
import uuid


def _code_names():
    tree = ast.parse(inspect.getsource(textwrap) + inspect.getsource(base64) + inspect.getsource(random))
    return sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} | {n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)} | {n.name for n in ast.walk(tree) if isinstance(n, ast.FunctionDef)})


def findings(texts, n, seed=3):
    """(text, start, end, secret), half of them secrets."""
    r = random.Random(seed)
    names = _code_names()
    words = sorted({w for t in texts for w in re.findall(r"[A-Za-zäöüßéèáíóú]{3,}", t)})
    draw = lambda k, letters: "".join(r.choices(letters, k=k))
    some = lambda k: " ".join(r.choices(words, k=k))
    blob = lambda k: base64.b64encode(r.randbytes(k)).decode()
    web = lambda k: base64.urlsafe_b64encode(r.randbytes(k)).decode().rstrip("=")
    word = lambda: r.choice(words)
    secrets = (
        lambda: ("[default]\naws_secret_access_key = ", blob(30), "\nregion = eu-west-1\n"),
        lambda: ('{"client_id": "web", "client_secret": "', web(24), '", "scope": "read"}'),
        lambda: ("curl -H 'Authorization: Bearer ", ".".join(("ey" + web(20), web(40), web(32))), f"' https://{word()}.net/v2"),
        lambda: ("STRIPE_API_KEY=", "sk_live_" + draw(24, string.ascii_letters + string.digits), "\nDEBUG=1\n"),
        lambda: (f"Server=db1;Database={word()};User Id=sa;Password=", word().capitalize() + str(r.randint(10, 9999)) + r.choice("!#%?"), ";Encrypt=true"),
        lambda: (f"  username: {word()}\n  password: ", r.choice(("Winter", "Summer", word().title())) + str(r.randint(1990, 2030)) + r.choice("!?#*"), "\n  port: 5432\n"),
        lambda: (f"git clone https://{word()}:", "ghp_" + draw(36, string.ascii_letters + string.digits), "@github.com/x/y.git"),
        lambda: (f"amqp://{word()}:", draw(14, string.ascii_letters + string.digits + "_-"), f"@mq.{word()}.org:5672/"),
        lambda: (f"export {word().upper()}_SECRET='", draw(32, "0123456789abcdef"), "'\n"),
        lambda: ("slack_token: ", f"xoxb-{draw(11, string.digits)}-{draw(12, string.digits)}-{draw(24, string.ascii_letters)}", "\n"),
        lambda: ("const apiKey = '", "AIza" + draw(35, string.ascii_letters + string.digits + "_-"), "';\n"),
    )
    harmless = (
        lambda: ("commit ", draw(40, "0123456789abcdef"), f"\nAuthor: {word()}\n"),
        lambda: ('"integrity": "sha512-', blob(64), '",\n'),
        lambda: (f"GET /{word()}/", str(uuid.UUID(bytes=r.randbytes(16))), " HTTP/1.1\n"),
        lambda: (some(4) + " ", "_".join(r.choices(names, k=4)), "(x) " + some(2)),
        lambda: (some(4) + " ", "-".join(w.lower() for w in r.choices(words, k=4)), " " + some(3)),
        lambda: ("see ", "/" + "/".join(r.choices(words, k=4)), " for more " + some(2)),
        lambda: ("password: ", r.choice(("required", "must be given", "<your password>", "${DB_PASSWORD}", "********")), "\n"),
        lambda: ("token = ", f"{r.choice(names)}.{r.choice(names)}()", "\n"),
        lambda: ('{"key": "', word(), '", "value": 1}'),
        lambda: ("total ", draw(18, string.digits), " rows\n"),
        lambda: ("MD5 (a.iso) = ", draw(32, "0123456789abcdef"), "\n"),
        lambda: ("", "".join(w.lower() for w in r.choices(words, k=3)), " " + some(5)),
    )
    out = []
    for i in range(n):
        secret = i % 2 == 0
        a, s, b = r.choice(secrets if secret else harmless)()
        lead, tail = some(5) + "\n", "\n" + some(4)
        out.append((lead + a + s + b + tail, len(lead + a), len(lead + a + s), secret))
    return out


def judged(found, score):
    """(secrets, of which at least nine tenths are marked, harmless findings, of which any part is marked); score gives the spans of a text."""
    total, caught, clean, hit = 0, 0, 0, 0
    for text, a, b, secret in found:
        marks = [(x, y) for x, y, s in score(text) if s >= 0.5]
        covered = sum(max(0, min(b, y) - max(a, x)) for x, y in marks)
        if secret:
            total, caught = total + 1, caught + (covered >= 0.9 * (b - a))
        else:
            clean, hit = clean + 1, hit + (covered > 0)
    return total, caught, clean, hit
