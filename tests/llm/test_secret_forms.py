"""Keys and tokens in forms that a single run of standard base64 or lower-case hex does not show."""
import base64

from repolumen.llm import secret_scan

from .test_documents import der, secrets


def structural(text):
    return [s for s in secret_scan.find_secrets(text) if s[0] in ("pem", "der", "ssh", "jwt")]


def wrapped(text, width, gap="\n"):
    return gap.join(text[i:i + width] for i in range(0, len(text), width))


def forms():
    number = lambda n: der(2, bytes([1] * n))
    rsa = der(0x30, number(1), *[der(2, bytes([251, 255, 62] * 14)) for _ in range(8)])
    dsa = der(0x30, der(2, b"\0"), number(128), number(20), number(128), number(128), number(20))
    text, ssh = base64.b64encode(rsa).decode(), secrets()["ssh"]
    block = "-----BEGIN {0} PRIVATE KEY-----\n{1}\n-----END {0} PRIVATE KEY-----"
    locked = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{}\n\n{}".format("0A" * 16, wrapped(base64.b64encode(bytes(range(160))).decode(), 64))
    assert base64.urlsafe_b64encode(rsa).decode() != text
    return {
        "upper hex": (rsa.hex().upper(), "der"), "mixed hex": (rsa.hex()[:40] + rsa.hex()[40:].upper(), "der"),
        "64 columns": (wrapped(text, 64), "der"), "76 columns": (wrapped(text, 76, "\r\n    "), "der"), "escaped": (wrapped(text, 64, "\\n"), "der"),
        "url": (base64.urlsafe_b64encode(rsa).decode(), "der"), "url lines": (wrapped(base64.urlsafe_b64encode(rsa).decode(), 64), "der"),
        "ssh lines": (wrapped(ssh, 70), "ssh"), "dsa": (base64.b64encode(dsa).decode(), "der"),
        "dsa block": (block.format("DSA", wrapped(base64.b64encode(dsa).decode(), 64)), "pem"),
        "headers": (block.format("RSA", "Comment: mine\n\n" + wrapped(text, 64)), "pem"), "locked": (block.format("RSA", locked), "pem"),
        "locked and escaped": (block.format("RSA", locked).replace("\n", "\\n"), "pem"),
    }


def test_other_forms_of_keys():
    for name, (text, kind) in forms().items():
        for after in (" here", "\nNext line", ""):
            assert structural(f"é see {text}{after}") == [(kind, 6, 6 + len(text))], (name, after)


def test_tokens_after_a_dotted_word():
    token = secrets()["jwt"]
    for before in ("authorization.", "some_long_name.another_long_name.", "x."):
        text = f"see {before}{token} here"
        assert structural(text) == [("jwt", text.index(token), text.index(token) + len(token))]
    assert not structural("one_long_word.another_long_word.and_a_third_long_word.and_a_fourth_long_word")


def test_other_forms_stay_unreported():
    number = lambda n: der(2, bytes([1] * n))
    odd = base64.b64encode(der(0x30, *[number(40) for _ in range(6)])).decode()  # six numbers, but no version
    locked = "-----BEGIN RSA PRIVATE KEY-----\nDEK-Info: AES-128-CBC,{}\n\n{}\n-----END RSA PRIVATE KEY-----".format("0A" * 16, base64.b64encode(bytes(150)).decode())
    for text in (odd, wrapped(odd, 64), wrapped(base64.b64encode(bytes(range(200))).decode(), 64), locked, bytes(range(90)).hex().upper()):
        assert not structural(f"see {text} here")
