import random

import pytest

WORDS = "the of and to in that was for on are with his they be at one have this from by hot but some what there we can out other were all your when up use word how said an each she".split()


@pytest.fixture
def prose():
    """A maker of random prose: prose(seed, n) has n words."""

    def make(seed, n):
        rnd = random.Random(seed)
        return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "ing", "ed", "x" + str(rnd.randrange(50))]) for _ in range(n))

    return make
