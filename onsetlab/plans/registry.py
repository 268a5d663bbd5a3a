"""All registered queries of the engine and their SQL; importing the modules registers them."""

from onsetlab.plans import details, events, models  # noqa: F401
from onsetlab.plans.base import QUERIES, SQL  # noqa: F401
