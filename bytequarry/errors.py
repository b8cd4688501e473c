"""Errors of the library. Row-wise operators put their message in an error column (PERMISSIVE) or raise them (FAILFAST)."""


class ByteError(Exception):
    """Any failure of a byte operator."""


class DecodeError(ByteError):
    """A coded stream is truncated or holds what no encoder writes."""


class FormatError(ByteError):
    """A container cannot be read: wrong magic, version, lengths or an unknown format."""


class IntegrityError(ByteError):
    """A checksum or digest differs from what was stored."""


class PasswordError(ByteError):
    """Sealed bytes do not open: wrong password or changed bytes."""


class RecoveryError(ByteError):
    """More shards are lost than parity can restore."""


class SecurityError(ByteError):
    """A path or an expansion is not safe."""
