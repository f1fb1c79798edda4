"""Nothing the operators need is a stream; log lines may arrive as one."""
