"""Column-expression helpers.  Everything here returns a ``Column`` built from
built-in Spark SQL functions, so it stays inside whole-stage codegen."""

from pricelens.functions.numeric import *  # noqa: F401,F403
from pricelens.functions.text import *  # noqa: F401,F403
from pricelens.functions.dates import *  # noqa: F401,F403
from pricelens.functions.nested import *  # noqa: F401,F403
