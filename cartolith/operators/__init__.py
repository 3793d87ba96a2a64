"""Row filters, reprojection, loss policy and text formats."""
