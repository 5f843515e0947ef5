from .shape import two_sided, distinct_union  # noqa: F401
from .topk import top_k  # noqa: F401
