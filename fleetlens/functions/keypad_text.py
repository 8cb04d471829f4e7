"""Letters and keyboard keys to telephone keypad digits, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Keypad letters per digit, and the keyboard key of each digit.
KEYPAD = {
    "1": "@",
    "2": "abc",
    "3": "def",
    "4": "ghi",
    "5": "jkl",
    "6": "mno",
    "7": "pqrs",
    "8": "tuv",
    "9": "wxyz",
    "0": " ",
}
KEYS = {"1": "q", "2": "w", "3": "e", "4": "a", "5": "s", "6": "d", "7": "z", "8": "x", "9": "c", "0": " "}

# Stands for a character that no digit reaches.
UNREACHABLE = "?"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_digits(word: Column | str) -> Column:
    """Digits of a word; characters outside the keypad become ``?``."""
    letters = "".join(KEYPAD.values())
    digits = "".join(digit * len(chars) for digit, chars in KEYPAD.items())
    reachable = F.regexp_replace(F.lower(_col(word)), f"[^{letters}]", UNREACHABLE)
    return F.translate(reachable, letters, digits)


def keys_to_digits(keys: Column | str) -> Column:
    """Digits of typed keys; any other key is an error."""
    keys = _col(keys)
    typed = "".join(KEYS.values())
    digits = F.translate(keys, typed, "".join(KEYS))
    wrong = F.raise_error(F.concat(F.lit("not a keypad key in: "), keys))
    return F.when(keys.rlike(f"^[{typed}]*$"), digits).otherwise(wrong)
