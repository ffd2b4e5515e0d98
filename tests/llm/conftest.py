import re

import pytest


@pytest.fixture()
def words():
    return lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
