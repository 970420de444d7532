"""Writers: releases, monthly tables, state diffs, exports."""
