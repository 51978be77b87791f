"""Random keys of any class of characters, length from 16 and prefix are found."""

import random
import string

import pyarrow as pa
import pytest

from kiln.llm import bpe, secrets

VOCAB = bpe.vocabulary("byte_bpe_50k.tiktoken")


def hits(texts):
    found = secrets.scan_texts(pa.array(texts, pa.large_string()), VOCAB)
    return [[(a, b) for a, k, b in found.get(i, ()) if k == 3] for i in range(len(texts))]


@pytest.mark.parametrize("n", [16, 19, 32])
@pytest.mark.parametrize("chars", [string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters, string.ascii_letters + string.digits])
def test_recall_on_random_keys(chars, n):
    rnd = random.Random(n)
    keys = ["".join(rnd.choice(chars) for _ in range(n)) for _ in range(300)]
    assert sum(x == [(8, 8 + n)] for x in hits([f"the key {k} here" for k in keys])) >= 290


def test_words_in_front_do_not_hide_a_key():
    key = "xK9mP2qR7vL4nT8wZ3bJ6"
    front = "configuration/production/authentication/information/"
    assert hits([front + key, f"{front}{key}/information"]) == [[(len(front), len(front) + len(key))]] * 2


def test_identifiers_and_numbers_are_no_keys():
    assert not any(hits(["getUserAccountInformationByName2", "some_long_function_name_with_words", "internationalization", "INTERNATIONALIZATION",
                         "4087441028983991", "----------------------", "4d44c79e-8bf7-c557-59c4-958dd60ed83d"]))
